"""Index, ask and delete through the engine; the store; streaming."""

import glob
import os

import pytest

from stratagraph.plans import fixture
from stratagraph.plans.engine import Engine
from stratagraph.sources.store import NotFound, NotReady, Store


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    extra = {"node_modules/x.js": "function no() {}", ".gitignore": "# c\nskipped/\n!x\n", "skipped/a.py": "x = 1", "bin.py": "a\x00b", "a.lock": "x"}
    for path, text in {**fixture.FILES, **extra}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)


def test_scan(spark, tree):
    from stratagraph.sources.repository import scan

    found = {r.file_path: r for r in scan(spark, tree, "r").collect()}
    assert set(found) == {*fixture.FILES, ".gitignore"} and found["shop/run.py"].text == fixture.FILES["shop/run.py"] and found["web/app.ts"].language == "typescript"


def test_engine(spark, tree, tmp_path):
    e = Engine(spark, Store(spark, str(tmp_path)))
    with pytest.raises(ValueError):
        e.register("git@host:x/y")
    rid = e.register("https://host/x/shop.git/")
    with pytest.raises(NotReady):
        e.ask(rid, ["?"])
    with pytest.raises(NotFound):
        e.ask("none", ["?"])
    e.index(rid, tree)
    row = e.store.get(rid)
    assert row["status"] == "ready" and row["name"] == "shop" and "python" in row["language_counts"]
    assert e.sql("select count(*) from nodes where node_type = 'Class'", rid).first()[0] == 5
    answers = e.ask(rid, ["What calls `total`?", "why are notes sent"]).collect()
    assert len(answers) == 2 and all(a.grounded for a in answers) and "shop/run.py" in answers[0].answer
    assert e.graph(rid) is e.graph(rid)
    e.index(rid, tree)  # once more: every table is replaced
    assert e.store.read("nodes", rid).where("node_type = 'Class'").count() == 5 and e.store.versions.numbers(rid) == [1, 2]
    for f in glob.glob(f"{tmp_path}/data/{rid}/nodes/*/*.parquet"):
        with open(f, "wb") as broken:
            broken.write(b"not a table")
        os.unlink(os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc"))
    e._forget_graph(rid)
    assert e.graph(rid).nodes.count() == 0 and e.ask(rid, ["why are notes sent"], "vector").count() == 1
    e.delete(rid)
    assert e.store.get(rid) is None and e.store.read("nodes", schema="node_id string").count() == 0


def test_upsert(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    df = lambda rows: spark.createDataFrame(rows, "repository_id string, id string, v int")
    s.upsert(df([("a", "1", 1), ("a", "2", 1), ("b", "1", 1)]), "t")
    s.upsert(df([("a", "2", 5), ("a", "3", 5)]), "t")
    assert sorted((r.repository_id, r.id, r.v) for r in s.read("t").collect()) == [("a", "1", 1), ("a", "2", 5), ("a", "3", 5), ("b", "1", 1)]


def test_stream(spark, tmp_path):
    from stratagraph.streaming.incremental import index_stream

    store = Store(spark, str(tmp_path / "s"))
    fixture.files(spark).write.parquet(str(tmp_path / "in"))
    index_stream(spark, str(tmp_path / "in"), store, "rows", str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s/rows")).where("kind = 'entity' and name = 'MemoryStore'").count() == 1
