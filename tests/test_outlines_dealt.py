"""Outlines of classes are written once, and only classes meet them, in tasks by the number of methods."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stratagraph.operators import chunking as C
from stratagraph.plans import scratch

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["embedding_texts", "entity_chunks", "all_chunks"])
def test_chunks_are_dealt_out_by_methods(spark, monkeypatch, name):
    monkeypatch.setattr(scratch, "TASK_ROWS", 50)  # 1,500 orders are methods; 4 are the session's shuffle partitions
    assert entry.queries()[name](spark, SF).rdd.getNumPartitions() >= 30


def test_a_line_is_put_together_before_lines_are(spark):
    rows = [(5, 2, "b", None), (5, 1, "a", "sig a"), (3, 9, "c", None), (4, 7, None, None), (None, 8, "d", None), (5, 2, "b", None)]
    text = lambda c, n: F.lit(c).cast("string").alias(n)
    methods = spark.createDataFrame(rows, "start_line int, seq long, entity_name string, signature string").select("*", text("r", "repository_id"), text("f.py", "file_path"), text("python", "language"), text("method", "entity_type"), F.lit(9).alias("end_line"), text("x", "source_code"), text("K", "parent_name"), text(None, "docstring"))
    (one,) = C.class_outlines(methods).collect()
    assert one.members.split("\n") == ["    def d(...)", "    def c(...)", "    sig a", "    def b(...)", "    def b(...)"]
    assert one.method_names == ["a", "b", "b", None, "d", "c"]
    outline = one.members
    classes = methods.limit(1).withColumns({"entity_type": F.lit("class"), "entity_name": F.lit("K"), "parent_name": F.lit(None).cast("string"), "signature": F.lit(None).cast("string")})
    assert [r.content for r in C.entity_chunks(methods.unionByName(classes), None).collect()] == [f"class K:\n{outline}"]


def test_what_begins_blank_is_measured_whole(spark):
    text = lambda c, n: F.lit(c).cast("string").alias(n)
    row = lambda kind, name, parent, signature: spark.range(1).select(text("r", "repository_id"), text("f.py", "file_path"), text("python", "language"), text(kind, "entity_type"), text(name, "entity_name"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), text("x", "source_code"), text(parent, "parent_name"), text(signature, "signature"), text(None, "docstring"), F.col("id").alias("seq"))
    for end, n in (("y" * 40, 1), ("y", 0)):
        found = C.entity_chunks(row("class", "K", None, " ").unionByName(row("method", "m", "K", " " * 200 + end)), None).where("entity_type = 'class'")
        assert found.count() == n


def test_module_names_are_counted(spark):
    row = lambda n, kind, name, doc=None: spark.range(n).select(F.lit("r").alias("repository_id"), F.lit("a/b.py").alias("file_path"), F.lit("python").alias("language"), F.lit(kind).alias("entity_type"), F.lit(name).cast("string").alias("entity_name"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.lit(doc).cast("string").alias("docstring"), F.col("id").alias("seq"))
    some = row(1, "module", "b", "What it does.").unionByName(row(3, "function", "g")).unionByName(row(2, "function", "f")).unionByName(row(2, "class", None)).unionByName(row(4, "method", "m"))
    (one,) = C.module_chunks(some).collect()
    assert (one.content, one.class_count, one.function_count) == ("Module a/b.py\nWhat it does.\nFunctions: f, f, g, g, g", 0, 5)
    assert C.module_chunks(row(1, "module", "b").unionByName(row(4, "method", "m"))).count() == 0
