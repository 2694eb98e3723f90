"""Versioned tables: every failure leaves the version before; upserts, conflicts, compaction, clean-up, re-indexing."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from stratagraph.plans.engine import Engine
from stratagraph.sources import versions as V
from stratagraph.sources.store import Store


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "id string, v int")


def content(v, scope="a", table="t", version=None):
    return sorted(tuple(r) for r in v.read(scope, table, version=version).collect())


@pytest.fixture
def v(spark, tmp_path):
    out = V.Versions(spark, str(tmp_path), {"t": ["id"]})
    out.replace("a", {"t": rows(spark, [("x", 1), ("y", 2)]), "u": rows(spark, [("p", 1)])})
    return out


@pytest.mark.parametrize("step", ["put", "write", "rename"])
def test_a_writer_that_dies_at_any_step_changes_nothing(spark, v, monkeypatch, step):
    """put: rows of the first table are written; write: all rows; rename: the manifest too."""
    owner = V.Versions if step == "put" else V.Files
    real, calls = getattr(owner, step), []

    def dies(self, *args, **more):
        calls.append(args)
        if step == "put" and len(calls) == 1:
            return real(self, *args, **more)
        if step == "write":
            real(self, *args, **more)
        raise OSError("the writer is gone")

    monkeypatch.setattr(owner, step, dies)
    with pytest.raises(OSError):
        v.replace("a", {"t": rows(spark, [("z", 9)]), "u": rows(spark, [])})
    monkeypatch.undo()
    assert content(v) == [("x", 1), ("y", 2)] and content(v, table="u") == [("p", 1)] and v.numbers("a") == [1]
    v.replace("a", {"t": rows(spark, [("z", 9)])})
    assert content(v) == [("z", 9)] and v.numbers("a") == [1, 2]


def test_a_rename_that_the_file_system_refuses_raises(v, spark, monkeypatch, tmp_path):
    monkeypatch.setattr(V.Files, "path", lambda self, name="", real=V.Files.path: real(self, name if not name.endswith("2.json") else "no/such/folder/2.json"))
    with pytest.raises(Exception, match="no/such/folder|FileNotFound"):
        v.replace("a", {"t": rows(spark, [("z", 9)])})
    monkeypatch.undo()
    assert content(v) == [("x", 1), ("y", 2)] and not [p for p in os.listdir(tmp_path / "versions/a") if p.endswith(".part")]


def test_empty_tables_replace_full_ones(spark, v):
    v.replace("a", {"t": rows(spark, [])})
    assert content(v) == [] and v.read("a", "t").columns == ["id", "v"] and content(v, table="u") == [("p", 1)]
    with pytest.raises(V.NoTable):
        v.read("a", "none")
    assert v.read("b", "t", "id string").count() == 0


def test_snapshots(spark, v):
    v.upsert("a", "t", rows(spark, [("y", 7)]))
    v.replace("a", {"t": rows(spark, [("n", 0)])})
    assert [content(v, version=k) for k in (1, 2, 3)] == [[("x", 1), ("y", 2)], [("x", 1), ("y", 7)], [("n", 0)]]
    with pytest.raises(V.NoTable):
        v.manifest("a", 9)


def test_two_writers(spark, v):
    """The slower one does its work again on what the faster one has left."""
    tries = []

    def change(tables):
        tries.append(sorted(tables))
        if len(tries) == 1:
            v.replace("a", {"w": rows(spark, [("w", 1)])})
        return tables | {"t2": tables["t"]}

    assert v.commit("a", change) == 3 and tries == [["t", "u"], ["t", "u", "w"]] and sorted(v.manifest("a")["tables"]) == ["t", "t2", "u", "w"]
    with pytest.raises(V.Conflict):
        v._publish("a", 3, {})


def test_upserts_equal_a_dictionary_and_write_little(spark, v, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "PARTS", 4)
    many = {f"k{i:05d}": i for i in range(5000)}
    v.replace("a", {"t": rows(spark, list(many.items())).repartition(3)})
    size = lambda: sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/data/a/t/**/*.parquet", recursive=True))
    first = size()
    for turn in range(1, 10):
        before, folders = size(), v.parts("a", "t")
        new = {f"k{i:05d}": -turn for i in range(turn * 40, turn * 40 + 60)} | {f"n{turn}": turn}
        v.upsert("a", "t", rows(spark, list(new.items())))
        many |= new
        assert content(v) == sorted(many.items())
        if v.parts("a", "t") > folders:
            assert size() - before < first / 3
    assert v.parts("a", "t") <= 8 and any(len(v.manifest("a", n)["tables"]["t"]["data"]) == 1 for n in v.numbers("a")[2:])


def test_upsert_edges(spark, v):
    wide = spark.createDataFrame([("y", 5, "new"), (None, 6, None), (None, 6, None)], "id string, v int, more string")
    v.upsert("a", "t", wide)
    v.upsert("a", "t", wide.where("id is null"))
    assert sorted(map(repr, (tuple(r) for r in v.read("a", "t").collect()))) == sorted(map(repr, [("x", 1, None), ("y", 5, "new")] + [(None, 6, None)] * 4))
    v.upsert("a", "t", wide.limit(0))
    v.upsert("new", "t", rows(spark, [("q", 1), ("q", 2)]))
    assert v.read("a", "t").count() == 6 and content(v, "new") == [("q", 1), ("q", 2)]


def test_bitmaps_keep_row_zero_and_bucket_bounds_apart(spark, tmp_path):
    v = V.Versions(spark, str(tmp_path))
    n = 70_000
    v.replace("a", {"t": spark.range(n).select(F.col("id"), F.lit(0).alias("v")).coalesce(1)})
    hit = [0, 1, 32767, 32768, 32769, 65535, 65536, n - 1]
    v.upsert("a", "t", spark.createDataFrame([(i, 1) for i in hit], "id long, v int"))
    t = v.read("a", "t")
    assert sorted(r.id for r in t.where("v = 1").collect()) == hit and t.where("v = 0").count() == n - len(hit) and t.select("id").distinct().count() == n


def test_vacuum(spark, v, tmp_path):
    for k in range(4):
        v.replace("a", {"t": rows(spark, [("z", k)])})
    assert v.vacuum("a", keep=2) == [] and v.numbers("a") == [4, 5]  # young folders stay
    gone = v.vacuum("a", keep=2, grace=0)
    assert len(gone) == 3 and content(v) == [("z", 3)] and content(v, version=4) == [("z", 2)] and content(v, table="u") == [("p", 1)]
    v.drop("a")
    v.drop("a")
    assert v.scopes() == [] and not os.path.exists(tmp_path / "data/a")


def test_catalog_is_compacted(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    a, b = s.register("https://h/a", "a"), s.register("https://h/b", "b")
    for k in range(24):
        s.set_status(a, "failed" if k % 2 else "parsing", f"e{k}" if k % 2 else None, {"python": k} if k == 3 else None)
    s.remove(b)
    row = s.get(a)
    assert (row["status"], row["error"], row["language_counts"], row["name"]) == ("failed", "e23", '{"python": 3}', "a") and s.get(b) is None
    assert s.versions.parts("catalog", "states") <= 17 and [r["repository_id"] for r in s.repositories().collect()] == [a]


def test_index_again_after_the_sources_went(spark, tmp_path):
    """Proven failures: a folder without sources, and one whose only source went, which kept its old entities."""
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "notes.bin").write_text("nothing to parse")
    e = Engine(spark, Store(spark, str(tmp_path / "store")))
    rid = e.register("https://host/x/one")
    e.index(rid, str(tree))
    assert e.store.get(rid)["status"] == "ready" and e.store.read("entities", rid).count() == 0 and e.graph(rid).edges.count() == 0
    (tree / "a.py").write_text("class A:\n    def go(self):\n        return 1\n")
    e.index(rid, str(tree))
    assert e.store.read("entities", rid).count() == 3 and e.graph(rid).nodes.where("node_type = 'Class'").count() == 1
    (tree / "a.py").unlink()
    e.index(rid, str(tree))
    assert e.store.read("entities", rid).count() == 0 and e.graph(rid).nodes.count() == 0 and e.store.get(rid)["status"] == "ready"
    assert e.ask(rid, ["what is A"]).count() == 1


def test_a_failed_index_leaves_the_old_tables(spark, tmp_path, monkeypatch):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.py").write_text("def one():\n    return 1\n")
    e = Engine(spark, Store(spark, str(tmp_path / "store")))
    rid = e.register("https://host/x/two")
    e.index(rid, str(tree))
    (tree / "b.py").write_text("def two():\n    return one()\n")
    monkeypatch.setattr(V.Versions, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")) if a[1] == rid else V_PUBLISH(*a))
    with pytest.raises(OSError):
        e.index(rid, str(tree))
    monkeypatch.undo()
    assert e.store.get(rid)["status"] == "failed" and {r.file_path for r in e.store.read("files", rid).collect()} == {"a.py"} and {r.file_path for r in e.store.read("entities", rid).collect()} == {"a.py"}


V_PUBLISH = V.Versions._publish


def test_a_read_error_is_not_kept(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.py").write_text("def one():\n    return 1\n")
    e = Engine(spark, Store(spark, str(tmp_path / "store")))
    rid = e.register("https://host/x/three")
    e.index(rid, str(tree))
    folder = f"{tmp_path}/store/data/{rid}/nodes"
    shutil.move(folder, f"{folder}-away")
    assert e.graph(rid).nodes.count() == 0
    shutil.move(f"{folder}-away", folder)
    assert e.graph(rid).nodes.count() == 3
    with pytest.raises(ZeroDivisionError):
        e.store.read = lambda *a, **b: 1 / 0
        e._forget_graph(rid)
        e.graph(rid)


def test_queries_of_two_repositories_do_not_meet(spark, tmp_path):
    e = Engine(spark, Store(spark, str(tmp_path / "store")))
    frames = []
    for name in ("p", "q"):
        tree = tmp_path / name
        tree.mkdir()
        (tree / f"{name}.py").write_text(f"def {name}():\n    return 1\n")
        rid = e.register(f"https://host/x/{name}")
        e.index(rid, str(tree))
        frames.append(e.sql("select name from nodes where node_type = 'Function'", rid))
    assert [[r[0] for r in f.collect()] for f in frames] == [["p"], ["q"]]
