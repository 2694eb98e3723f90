"""A query has no column that tells what failed, so a failure is raised there and not shown as a smaller result."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from stratagraph.operators import facts as H
from stratagraph.plans.scratch import materialize

SF = "/root/testdata/sf0.001"


def _down(*args, **kwargs):
    raise OSError("the store is down")


@pytest.mark.parametrize("retriever", ["vector_items", "graph_context", "expansion"])
def test_hybrid_tables_raises(spark, monkeypatch, retriever):
    monkeypatch.setattr(H, retriever, _down)
    with pytest.raises(OSError, match="the store is down"):
        entry.queries()["hybrid_tables"](spark, SF)


def test_hybrid_retrieve_raises(spark, monkeypatch):
    real = H.materialize
    monkeypatch.setattr(H, "materialize", lambda df, name: _down() if name == "vector_found" else real(df, name))
    with pytest.raises(OSError, match="the store is down"):
        entry.queries()["hybrid_retrieve"](spark, SF)


def test_rows_that_are_not_there_again_are_an_error(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    df = spark.range(0, 100, 1, 4)
    assert [materialize(x, "kept").count() for x in (df, df.where("id < 0"), df.limit(0))] == [100, 0, 0]
    real = DataFrameWriter.parquet

    def elsewhere(self, path):
        """One task's file is in a folder of its executor."""
        real(self, path)
        next(Path(path.removeprefix("file:")).glob("part-00001*")).unlink()

    monkeypatch.setattr(DataFrameWriter, "parquet", elsewhere)
    with pytest.raises(RuntimeError, match="75 of 100 rows"):
        materialize(df, "lost")


def test_a_file_that_goes_later_is_an_error(spark):
    df = materialize(spark.range(0, 100, 1, 4), "later")
    spark.conf.set("spark.sql.files.ignoreMissingFiles", "true")
    try:
        next(Path(df.inputFiles()[0].removeprefix("file://")).parent.glob("part-00001*")).unlink()
        with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
            df.collect()
    finally:
        spark.conf.unset("spark.sql.files.ignoreMissingFiles")
