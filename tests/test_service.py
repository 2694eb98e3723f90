"""The whole evaluation, the REST routes, the command line, connectors, clones and model slots."""

import json
import subprocess
import threading
import urllib.parse
import urllib.request
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagraph.functions.models import model_embedding
from stratagraph.operators import generation as L
from stratagraph.operators.grounding import UNVERIFIED, answers_for
from stratagraph.plans import benchmark, fixture
from stratagraph.plans.engine import Engine
from stratagraph.service import Service
from stratagraph.sources.git import CloneFailed, clone
from stratagraph.sources.store import Store

QUESTIONS = [
    {"question": "What calls `total`?", "category": "relationship", "relevant_files": ["shop/run.py", "shop/store/base.py"], "entities": ["main", "sum_up"]},
    {"question": "Which classes inherit from BaseStore?", "category": "component", "relevant_files": ["shop/store/memory.py"], "entities": ["MemoryStore"]},
    {"question": "zzz qqq", "category": "none", "relevant_files": [], "entities": []},
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    for path, text in fixture.FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


@pytest.fixture(scope="module")
def ready(spark, folder, tmp_path_factory):
    engine = Engine(spark, Store(spark, str(tmp_path_factory.mktemp("store"))))
    rid = benchmark.prepare(engine, "https://host/x/shop", str(folder))
    return engine, rid


def test_prepare_reuses(ready):
    engine, rid = ready
    assert benchmark.prepare(engine, "https://host/x/shop") == rid == benchmark.prepare(engine, "shop")
    with pytest.raises(ValueError):
        benchmark.prepare(engine, "https://host/x/other")


def test_evaluation_and_report(spark, ready, tmp_path):
    engine, rid = ready
    (tmp_path / "q.json").write_text(json.dumps(QUESTIONS))
    questions = benchmark.load_questions(spark, str(tmp_path / "q.json"))
    results = benchmark.run(engine, rid, questions)
    rows = {(r.system, r.question_id): r for r in results.collect()}
    assert len(rows) == 6 and rows["hybrid", 0].recall_at_10 == 1.0 and rows["hybrid", 1].mrr > 0 and rows["hybrid", 2].recall_at_1 == 1.0
    assert all(r.retrieval_s > 0 and r.generation_s > 0 and not r.hallucinated for r in rows.values()) and rows["hybrid", 0].entity_coverage == 1.0
    paths = benchmark.report(engine, rid, "small", results)
    with open(paths[0].removeprefix("file:")) as f:
        found = json.load(f)
    assert found["repository"]["files"] == len(fixture.FILES) and {m["metric"] for m in found["comparison"]} >= {"mrr", "citation_accuracy"} and len(found["questions"]) == 6
    with open(paths[1].removeprefix("file:")) as f:
        text = f.read()
    assert "## Means" in text and "| mrr |" in text
    plain = benchmark.run(engine, rid, questions, systems=("vector",), generate=False)
    assert "generation_s" not in plain.columns and plain.count() == 3


def test_reads(ready):
    engine, rid = ready
    assert [r.file_path for r in engine.files(rid).collect()] == sorted(p for p in fixture.FILES if p.endswith((".py", ".ts", ".js", ".md")) and p not in ("empty.py", "broken.py")) or engine.files(rid).count() > 5
    assert {r.name for r in engine.callers(rid, "total").collect()} == {"main", "sum_up"} and "rate" in {r.name for r in engine.callees(rid, "total").collect()}
    assert {r.file_path for r in engine.importers(rid, "shop/prices.py").collect()} == {"shop/run.py", "shop/store/base.py"}
    assert engine.path(rid, "shop/run.py", "shop/store/base.py").first().path == ["shop/run.py", "shop/store/memory.py", "shop/store/base.py"]
    assert engine.class_info(rid, "MemoryStore").first().bases[0].name == "BaseStore" and engine.network(rid)[0].count() > 3 and engine.file(rid, "../x").count() == 0
    nodes, edges = engine.network(rid, "Function:shop/prices.py:total", 1)
    assert nodes.where("focus").count() == 1 and edges.count() >= 2
    assert "Imported most: shop/prices.py (2 importers)" in engine.summary(rid) and "shop/run.py" in engine.overview_context(rid)
    assert "No language model answers" in engine.overview(rid) and "Flask" in engine.overview(rid)


def test_routes(ready, folder, tmp_path):
    engine, rid = ready
    s = Service(engine, str(tmp_path), background=False, folders=str(folder.parent))
    get = lambda t: s.answer("GET", t)
    assert get("/health")[1]["storage"] is True and get("/config")[1]["per_file"] == 4 and get("/nowhere")[0] == 404 and get("/repositories/0abc")[0] == 404
    assert get(f"/repositories/{rid}/status") == (200, {"status": "ready", "error": None}) and rid in [r["repository_id"] for r in get("/repositories")[1]["rows"]]
    for t in ("files", "overview", "graph", "graph/network", "graph/class?name=BaseStore", "graph/callers?name=total", "graph/callees?name=main", "graph/importers?path=shop/prices.py", "graph/imports?path=shop/run.py", "file?path=shop/run.py", "graph/file?path=shop/run.py", "graph/path?source=shop/run.py&target=shop/prices.py"):
        code, found = get(f"/repositories/{rid}/{t}")
        assert code == 200 and found, t
    assert get(f"/repositories/{rid}/graph/path?source=shop/prices.py&target=shop/run.py")[0] == 404 and get(f"/repositories/{rid}/graph/callers")[0] == 400
    post = lambda t, b: s.answer("POST", t, json.dumps(b).encode())
    assert "shop/run.py" in post(f"/repositories/{rid}/query", {"question": "What calls `total`?"})[1]["answer"] and post(f"/repositories/{rid}/query", {"question": "x", "mode": "odd"})[0] == 400
    assert post("/repositories", {"url": "nonsense"})[0] == 400 and post("/repositories", {})[0] == 400
    assert all(post("/repositories", {"url": "https://host/x/second", "folder": f}) == (400, {"error": "folder: this server does not index it"}) for f in ("/etc", f"{folder.parent}/../..", "relative"))
    assert Service(engine, str(tmp_path)).answer("POST", "/repositories", json.dumps({"url": "https://host/x/second", "folder": str(folder)}).encode())[0] == 400
    small, seen, mark = Service(engine, str(tmp_path), size=2), [], ""
    while mark is not None:
        code, found = small.answer("GET", f"/repositories/{rid}/files" + (f"?after={urllib.parse.quote(mark)}" if mark else ""))
        assert code == 200 and len(found["rows"]) <= 2
        seen, mark = seen + [r["file_path"] for r in found["rows"]], found["next"]
    assert seen == [r.file_path for r in engine.files(rid).collect()] and len(seen) > 2
    assert get(f"/repositories/{rid}/files?after=x")[0] == 400 and get(f"/repositories/{rid}/files?after=[1,2]")[0] == 400
    code, row = post("/repositories", {"url": "https://host/x/second", "folder": str(folder)})
    assert code == 202 and row["status"] == "ready" and s.answer("DELETE", f"/repositories/{row['repository_id']}") == (204, None)
    engine.store.register("https://host/x/third", "third")
    waiting = next(r["repository_id"] for r in get("/repositories")[1]["rows"] if r["name"] == "third")
    assert get(f"/repositories/{waiting}/files")[0] == 409
    server = s.server(port=0)
    threading.Thread(target=server.handle_request, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/config", timeout=60) as r:
        assert json.loads(r.read())["per_file"] == 4
    server.server_close()


class Model(BaseHTTPRequestHandler):
    """A server of both styles; it fails for contexts that hold the word break."""

    def _do(self):
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
        code = 500 if "break" in body else 200
        out = {"response": "It is in shop/run.py:8-14."} if self.path == "/api/generate" else {"choices": [{"message": {"content": "See nowhere.py:1-2"}}]}
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(out).encode())

    do_GET = do_POST = _do

    def log_message(self, *_):
        pass


def test_connectors(spark):
    server = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    contexts = spark.createDataFrame([(1, "Place: shop/run.py:8-14", "where?"), (2, "break Place: a.py:1-2", "?"), (3, L.NO_EVIDENCE, "?")], "question_id int, context string, question string").coalesce(1)
    ranked = spark.createDataFrame([(1, 1, "shop/run.py", 8, 14), (2, 1, "a.py", 1, 2)], "question_id int, position int, file_path string, start_line int, end_line int")
    one = {r.question_id: r for r in answers_for(contexts, ranked, L.choose_provider(L.Connector(url, "m"))).collect()}
    assert one[1].answer == "It is in shop/run.py:8-14." and one[1].verified == 1 and "a.py:1-2" in one[2].answer and one[3].abstained
    two = {r.question_id: r for r in answers_for(contexts, ranked, L.choose_provider(L.Connector(url, "m", "chat", "key"))).collect()}
    assert two[1].answer.startswith(f"See nowhere.py{UNVERIFIED}") and "shop/run.py:8-14" in two[1].answer and not two[1].grounded
    server.shutdown()
    server.server_close()
    assert L.choose_provider(L.Connector(url, "m")) is L.extractive_answers and L.configured({}) is None
    assert L.configured({"STRATAGRAPH_LLM_URL": "u", "STRATAGRAPH_LLM_STYLE": "chat"}).style == "chat"


def test_a_provider_that_fails_while_it_runs(spark):
    contexts = spark.createDataFrame([(1, "Place: a.py:1-2")], "question_id int, context string")
    ranked = spark.createDataFrame([(1, 1, "a.py", 1, 2)], "question_id int, position int, file_path string, start_line int, end_line int")
    broken = lambda c: c.select("question_id", F.raise_error(F.lit("down")).cast("string").alias("answer"), F.lit(False).alias("abstained"))
    assert "a.py:1-2" in answers_for(contexts, ranked, broken).first().answer


def test_clone(tmp_path):
    origin = tmp_path / "origin"
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q", str(origin))
    (origin / "a.py").write_text("x = 1\n")
    run("-C", str(origin), "add", ".")
    run("-C", str(origin), "commit", "-qm", "one")
    for _ in range(2):
        assert open(f"{clone(f'file://{origin}', str(tmp_path / 'w'), 'r1')}/a.py").read() == "x = 1\n"
    with pytest.raises(CloneFailed):
        clone(f"file://{tmp_path}/none", str(tmp_path / "w"), "r2")
    with pytest.raises(ValueError):
        clone("--upload-pack=x", str(tmp_path / "w"), "r3")
    with pytest.raises(ValueError):
        clone("file:///x", str(tmp_path / "w"), "../r3")


def test_model_slot(spark):
    embed = model_embedding("lengths", lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    rows = spark.createDataFrame([("abc",), (None,)], "t string").select(embed(F.col("t")).alias("v")).collect()
    assert np.allclose(rows[0].v, np.array([3, 1]) / 10**0.5) and rows[1].v == [0.0, 1.0]


def test_command_line(spark, folder, tmp_path, capsys):
    from stratagraph.__main__ import main

    (tmp_path / "q.json").write_text(json.dumps(QUESTIONS[:1]))
    store = ["--store", str(tmp_path / "s")]
    assert main([*store, "index", "https://host/x/shop", "--folder", str(folder), "--ask", "What calls `total`?", "--overview"], spark) == 0
    out = capsys.readouterr().out
    assert "is ready" in out and "shop/run.py" in out and "## Structure" in out
    assert main([*store, "evaluate", "shop", str(tmp_path / "q.json"), "--retrieval-only"], spark) == 0
    assert capsys.readouterr().out.split()[1].endswith("reports/evaluation.md")


def test_layout_and_files(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.ensure("r", "things", "repository_id string, id string")
    s.ensure("r", "things", "repository_id string, id string")
    assert s.ping() and s.read("things", "r").count() == 0 and s.versions.numbers("r") == [1, 2]
    path = s.write_text("a/b.txt", "é")
    assert open(s.write_text("a/b.txt", "ü").removeprefix("file:"), encoding="utf-8").read() == "ü" and path.endswith("a/b.txt")
