"""Parsers, resolution, graph and retrieval on the inline repository."""

import pytest
from pyspark.sql import functions as F

from stratagraph.functions.javascript_source import parse_javascript
from stratagraph.functions.python_source import parse_python
from stratagraph.operators import facts as H
from stratagraph.operators import graph as G
from stratagraph.operators.parsing import Parsed, parse_repository
from stratagraph.operators.questions import analyse
from stratagraph.plans import fixture
from stratagraph.plans.scratch import materialize


@pytest.fixture(scope="module")
def built(spark):
    p = parse_repository(fixture.files(spark))
    p = Parsed(*[materialize(getattr(p, n), n) for n in ("entities", "imports", "calls", "inherits", "errors")])
    g = G.build_graph(p.entities, p.imports, p.calls, p.inherits)
    return p, G.Graph(materialize(g.nodes, "nodes"), materialize(g.edges, "edges"))


def test_python_rows():
    rows = parse_python("shop/run.py", fixture.FILES["shop/run.py"])
    names = [(r["type"], r["name"], r.get("parent")) for r in rows if r["kind"] == "entity"]
    assert names == [("module", "run", None), ("function", "main", None), ("function", "helper", None), ("function", "inner", "helper")]
    assert [r["module"] for r in rows if r["kind"] == "import"] == ["shop.store.memory", "shop", "json"]
    main = next(r for r in rows if r.get("name") == "main" and r["kind"] == "entity")
    assert main["calls"] == ["MemoryStore", "dumps", "helper", "print", "put", "total"] and main["signature"] == "def main(argv: list) -> int" and main["docstring"] == "Run until done."
    assert parse_python("x.py", "def (:") == []
    assert [r["name"] for r in parse_python("e.py", "")] == ["e"]


def test_python_blocks_and_scopes():
    rows = parse_python("m.py", "try:\n    import a as b\nexcept E:\n    def f(): g()\nfor i in x:\n    def hidden(): pass\nclass C(p.Q[int], R):\n    @dec(1)\n    async def m(self): return n(o())\n")
    ents = [(r["type"], r["name"]) for r in rows if r["kind"] == "entity"]
    assert ents == [("module", "m"), ("function", "f"), ("class", "C"), ("method", "m")]
    assert [(r["name"], r["callee"]) for r in rows if r["kind"] == "inherit"] == [("C", "Q"), ("C", "R")]
    assert next(r for r in rows if r["kind"] == "import")["names"] == ["b"]
    assert {r["callee"] for r in rows if r["kind"] == "call" and r["name"] == "m"} == {"dec", "n", "o"}


def test_javascript_rows():
    rows = parse_javascript("web/app.ts", fixture.FILES["web/app.ts"])
    ents = {(r["type"], r["name"]): r for r in rows if r["kind"] == "entity"}
    assert set(ents) == {("module", "app"), ("class", "App"), ("method", "start"), ("function", "helper"), ("function", "bump"), ("function", "inner")}
    assert ents["class", "App"]["bases"] == ["Base", "Named"] and ents["method", "start"]["parent"] == "App" and ents["method", "start"]["calls"] == ["helper", "name"]
    assert ents["function", "helper"]["docstring"] == "/** Adds one. */" and ents["function", "helper"]["calls"] == ["bump"] and ents["function", "inner"]["parent"] == "bump"
    assert [(r["module"], r["relative"]) for r in rows if r["kind"] == "import"] == [("./base", True), ("fs", False)]
    base = {(r["type"], r["name"]): r for r in parse_javascript("web/base.ts", fixture.FILES["web/base.ts"]) if r["kind"] == "entity"}
    assert ("class", "Named") in base and base["class", "Base"]["docstring"].startswith("/** A thing")
    main = parse_javascript("web/main.js", fixture.FILES["web/main.js"])
    assert [r["module"] for r in main if r["kind"] == "import"] == ["./app"]
    assert parse_javascript("x.js", "}{ ((") is not None


def test_resolution_and_graph(built):
    p, g = built
    imports = {(r.source_file, r.module): r.resolved_file for r in p.imports.collect()}
    assert imports["shop/run.py", "shop.store.memory"] == "shop/store/memory.py" and imports["shop/run.py", "shop"] == "shop/prices.py" and imports["shop/run.py", "json"] is None
    assert imports["shop/store/base.py", "..prices"] == "shop/prices.py" and imports["web/app.ts", "./base"] == "web/base.ts" and imports["web/main.js", "./app"] == "web/app.ts"
    calls = {(r.caller_name, r.callee_name): r.callee_file for r in p.calls.collect()}
    assert calls["main", "total"] == "shop/prices.py" and calls["put", "notify"] == "shop/store/memory.py" and calls["total", "rate"] == "shop/prices.py"
    assert ("notify", "send") not in calls  # two definitions, none imported
    edges = {(r.rel_type, r.src, r.dst) for r in g.edges.collect()}
    assert ("CLASS_INHERITS_CLASS", "Class:shop/store/memory.py:MemoryStore", "Class:shop/store/base.py:BaseStore") in edges
    assert ("METHOD_CALLS_METHOD", "Method:shop/store/memory.py:MemoryStore:put", "Method:shop/store/memory.py:MemoryStore:notify") in edges
    assert ("FILE_IMPORTS_FILE", "File:shop/run.py", "File:shop/prices.py") in edges
    ids = {r.node_id for r in g.nodes.collect()}
    assert {e[1] for e in edges} | {e[2] for e in edges} <= ids


def test_class_info_and_contents(built):
    _, g = built
    info = G.class_info(g.nodes, g.edges, "BaseStore").collect()
    assert len(info) == 1 and [m["name"] for m in info[0]["methods"]] == ["put", "sum_up"] and info[0]["bases"] is None and [s["name"] for s in info[0]["subclasses"]] == ["MemoryStore"]
    inside = G.contents(g.nodes, "shop/prices.py").first()
    assert [f["name"] for f in inside["functions"]] == ["total", "rate"] and G.contents(g.nodes, "none.py").count() == 0


def test_facts(spark, built):
    questions = spark.createDataFrame([(k, fixture.REPOSITORY, q) for k, q in fixture.QUESTIONS], "question_id int, repository_id string, question string")
    facts = H.graph_context(analyse(questions), built[1]).where("fact is not null").collect()
    by = {}
    for r in facts:
        by.setdefault(r.question_id, []).append(r.fact)
    assert any(f.startswith("function main (shop/run.py:") and f.endswith("calls total") for f in by[1])
    assert any(f == "classes inheriting from BaseStore: MemoryStore (shop/store/memory.py)" for f in by[2])
    assert any(f.startswith("shop/prices.py is imported by: shop/run.py, shop/store/base.py") for f in by[3])
    assert any(f.startswith("Files imported most: shop/prices.py (2 importers)") for f in by[4])
    assert any(f == "shop/prices.py defines functions rate, total" for f in by[6])
    assert any(f.startswith("main calls total (shop/prices.py:") for f in by[7]) and 8 not in by


def test_graph_build_merges_duplicates(spark):
    e = spark.createDataFrame([("r", "a.py", "python", "function", "f", 1, 2, None, "old", None, 1), ("r", "a.py", "python", "function", "f", 5, 6, None, "new", None, 2)], "repository_id string, file_path string, language string, entity_type string, entity_name string, start_line int, end_line int, parent_name string, signature string, docstring string, seq long")
    none = lambda s: spark.createDataFrame([], s)
    g = G.build_graph(e, none("repository_id string, seq long, source_file string, resolved_file string, module string, line int"), none("repository_id string, seq long, caller_file string, caller_name string, callee_file string, callee_name string, line int"), none("repository_id string, child_file string, child_class string, parent_file string, parent_class string"))
    f = g.nodes.where(F.col("node_type") == "Function").collect()
    assert len(f) == 1 and f[0].signature == "new"


def test_method_names_of_every_kind():
    from stratagraph.functions.javascript_source import parse_javascript

    source = "class A {\n  [Symbol.iterator]() { return walk(); }\n  #hidden(x) { return x; }\n  'quoted name'() {}\n  42() {}\n  static async *gen() { yield this.#hidden(1); }\n  #field = 3;\n  [key] = 4;\n  get size() { return 1; }\n  plain() {}\n}\nconst B = class { no() {} };\nconst o = { no() {}, also: function () {} };\n"
    rows = parse_javascript("a.js", source)
    assert [r["name"] for r in rows if r["kind"] == "entity" and r["type"] == "method"] == ["[Symbol.iterator]", "#hidden", "'quoted name'", "42", "gen", "size", "plain"]
    assert ("[Symbol.iterator]", "walk") in [(r["name"], r["callee"]) for r in rows if r["kind"] == "call"] and [r["name"] for r in rows if r["kind"] == "entity" and r["type"] == "class"] == ["A"]
