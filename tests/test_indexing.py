"""A later index gives what a whole one gives, and reads what has changed; change functions by hand; one listing of a tree."""

import random

import pytest

from stratagraph.functions.vectors import hashing_embedding
from stratagraph.operators import changes as D
from stratagraph.plans import indexing as I
from stratagraph.sources.store import Store

TABLES = ("files", "entities", "chunks", "nodes", "edges", "imports", "calls", "inherits")


def write(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def source(rng, folders):
    """A Python file of a few imports, classes and functions; names are few, so that they are defined in several files."""
    out = [f"from {rng.choice(folders)}.m{rng.randrange(6)} import f{rng.randrange(8)}" for _ in range(rng.randrange(3))]
    out += [f"from {rng.choice(folders)} import m{rng.randrange(6)}", f"from .m{rng.randrange(6)} import K{rng.randrange(5)}"][: rng.randrange(3)]
    for _ in range(rng.randrange(3)):
        out += [f"class K{rng.randrange(5)}(K{rng.randrange(5)}):", f"    def f{rng.randrange(8)}(self):", f"        return f{rng.randrange(8)}()"]
    for _ in range(rng.randrange(1, 4)):
        out += [f"def f{rng.randrange(8)}(a):", f"    return f{rng.randrange(8)}(a) + {rng.randrange(9)}"]
    return "\n".join(out) + "\n"


def rows(df):
    plain = lambda v: tuple(v) if isinstance(v, list) else v
    columns = sorted(c for c in df.columns if c != "seq")
    return sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)


def test_equals_whole_index(spark, tmp_path):
    rng, folders = random.Random(5), ["a", "a/b", "c"]
    root = tmp_path / "tree"
    write(root, {f"{f}/m{k}.py": source(rng, ["a", "a.b", "c"]) for f in folders for k in range(5)} | {"README.md": "# Title\n\nA text that is long enough to be a section.\n", "old/x.js": "export function f1() { return f2(); }\n"})
    # What is called stays a method of this file, but not of this class: only the edge differs.
    write(root, {"z/two.py": "class A:\n    def only(self):\n        return 1\n", "z/use.py": "from z.two import only\ndef go():\n    return only()\n"})
    store, fresh = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "f"))
    index = lambda s, full=False: I.index(spark, s, "r", str(root), hashing_embedding, lambda *a, **k: None, full)
    first = index(store)
    assert first.whole and first.files == 19
    edits = [
        {"c/m1.py": source(rng, ["a", "c"]), "a/b/m5.py": source(rng, ["c"]), "c/m2.py": None, "README.md": "# Title\n\nAnother text that is long enough for a section.\n", "z/two.py": "class B:\n    def only(self):\n        return 1\n"},
        {"a/m0.py": "", "a/m1.py": None, "old/x.js": None, "d/m7.py": source(rng, folders), ".gitignore": "old\n"},
    ]
    for edit in edits:
        write(root, {p: t for p, t in edit.items() if t is not None})
        for p in [p for p, t in edit.items() if t is None]:
            (root / p).unlink()
        done = index(store)
        assert not done.whole and done.files == sum(t is not None for t in edit.values())
        whole = index(fresh, True)
        assert whole.whole and done.references <= whole.references
        for table in TABLES:
            assert rows(store.read(table, "r")) == rows(fresh.read(table, "r")), table
    again = index(store)
    assert (again.whole, again.files, again.references) == (False, 0, 0) and store.versions.numbers("r")[-1] == 4

    def other(c):
        return hashing_embedding(c)

    assert I.index(spark, store, "r", str(root), other, lambda *a, **k: None).whole  # vectors of two encoders are not mixed


F_ROWS = "repository_id string, file_path string, digest string"


def test_changed_files(spark):
    old = spark.createDataFrame([("r", "a/x.py", "1"), ("r", "a/y.py", "2"), ("r", "b/z.py", "3"), ("r", "top.py", "4"), ("q", "a/x.py", "1")], F_ROWS)
    new = spark.createDataFrame([("r", "a/x.py", "9"), ("r", "b/z.py", "3"), ("r", "c/n.py", "5"), ("r", "top.py", "4"), ("q", "a/x.py", "1")], F_ROWS)
    folders = D.changed_folders(D.folder_digests(old), D.folder_digests(new))
    assert sorted(map(tuple, folders.collect())) == [("r", ""), ("r", "a"), ("r", "c")]
    want = [("r", "a/x.py", "changed"), ("r", "a/y.py", "removed"), ("r", "c/n.py", "added")]
    assert sorted(map(tuple, D.changed_files(old, new, folders).collect())) == sorted(map(tuple, D.changed_files(old, new).collect())) == want
    none = old.limit(0)
    assert D.changed_files(none, none, D.changed_folders(D.folder_digests(none), D.folder_digests(none))).count() == 0
    assert D.folder_digests(old).where("repository_id = 'r' and folder = ''").first().files == 4


def test_stale_references(spark):
    imports = spark.createDataFrame(
        [("r", 1, "a/m.py", "pkg.one", [], False), ("r", 2, "a/m.py", "pkg", ["two"], False), ("r", 3, "web/a.ts", "./b", [], True), ("r", 4, "a/m.py", "", [], False), ("q", 1, "a/m.py", "pkg.one", [], False)],
        "repository_id string, seq long, source_file string, module string, imported_names array<string>, is_relative boolean",
    )
    moved = lambda *paths: spark.createDataFrame([("r", p) for p in paths], "repository_id string, path string")
    ids = lambda df: sorted((r.repository_id, r.seq) for r in df.collect())
    assert ids(D.stale_imports(imports, moved("deep/pkg/one.py"))) == [("r", 1)]
    assert ids(D.stale_imports(imports, moved("pkg/two/__init__.py", "web/b/index.tsx"))) == [("r", 2), ("r", 3)]
    assert ids(D.stale_imports(imports, moved("other.py"))) == []
    entity = "repository_id string, seq long, file_path string, entity_type string, entity_name string"
    old = spark.createDataFrame([("r", 1, "a", "function", "f"), ("r", 2, "a", "function", "g"), ("r", 3, "a", "class", "K")], entity)
    new = spark.createDataFrame([("r", 7, "a", "function", "f"), ("r", 8, "a", "method", "g"), ("r", 9, "a", "class", "K"), ("r", 10, "a", "class", "K")], entity)
    assert sorted(map(tuple, D.changed_names(old, new).collect())) == [("r", "K", True), ("r", "g", False)]


@pytest.mark.parametrize("budget", [1, 500])
def test_listing(spark, tmp_path, monkeypatch, budget):
    from stratagraph.sources import repository as S

    monkeypatch.setattr(S, "FOLDERS_A_TASK", budget)
    write(tmp_path, {"a.py": "x", "_b/c.py": "y", ".d/e.py": "", "f/g/h.py": "z", "node_modules/n.py": "no", "bin.py": "a\0b", "f/skip.lock": "no", "big.py": "x" * (S.MAX_FILE_BYTES + 1)})
    (tmp_path / "link.py").symlink_to(tmp_path / "a.py")
    assert sorted(r.path for r in S.listing(spark, str(tmp_path)).collect()) == [".d/e.py", "_b/c.py", "a.py", "bin.py", "f/g/h.py", "f/skip.lock"]
    opened = sorted(r.path for r in S.listed_files(spark, str(tmp_path)).collect())
    assert "f/skip.lock" not in opened and sorted(r.file_path for r in S.scan(spark, str(tmp_path), "r").collect()) == [".d/e.py", "_b/c.py", "a.py", "f/g/h.py"]
    # What a condition leaves out is not opened, so a file that cannot be read does no harm.
    reads, one = [], S.read_named
    monkeypatch.setattr(S, "read_named", lambda root, names: reads.append(sorted(r.path for r in names.collect())) or one(root, names))
    assert [r.file_path for r in S.scan(spark, str(tmp_path), "r", False, "language = 'python' and length > 0 and file_path like 'f/%'").collect()] == ["f/g/h.py"]
    assert reads == [["f/g/h.py"]]
    gone = S.listed_files(spark, str(tmp_path)).unionByName(spark.createDataFrame([("went.py", 1)], "path string, length long"))
    assert S.file_rows(str(tmp_path), gone, "r").count() == 4
