"""Search in cells against the plain score of every pair, with ties, nulls and odd vectors, and what it reads."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratagraph.functions.vectors import dot, length
from stratagraph.operators import facts as H
from stratagraph.operators import vector_search as V
from stratagraph.plans.scratch import materialize


def test_cells_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(V, "CELL_ROWS", 40)
    monkeypatch.setattr(V, "CELL_QUERIES", 3)
    rng = random.Random(3)
    vector = lambda: [rng.choice([0.0, 0.25, -1.0, rng.gauss(0, 1)]) for _ in range(6)]
    rows = [(k, "ab"[k % 10 > 6], vector()) for k in range(300)]
    rows += [(300 + k, "a", [1.0, 1.0, 0.0, 0.0, 0.0, 0.0]) for k in range(60)]  # copies: ties go by id
    rows += [(400, "a", None), (401, "a", [1.0]), (402, "b", [None] * 6), (403, "a", [0.0] * 6), (404, "c", vector()), (405, "b", [float("nan")] * 6), (406, None, vector())]
    v = materialize(spark.createDataFrame(rows, "id long, kind string, v array<double>"), "v")
    q = materialize(v.where("id % 9 = 0 or id >= 400").select(F.col("id").alias("query_id"), "kind", F.col("v").alias("__q"), F.lit(5).alias("__k")), "q")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = lambda df: sorted(map(repr, df.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("query_id", "id", "rank", "score").collect()))
    score = F.round(dot(F.col("__q"), F.col("v")) / (length(F.col("__q")) * length(F.col("v"))), 6).alias("score")
    want = best(v.join(q, "kind").select("query_id", "id", score))
    assert best(V.nearest(v.withColumnRenamed("v", "__v"), q, ["id"], "kind")) == want
    want = best(v.join(q.drop("kind")).where("id <> query_id").select("query_id", "id", score))
    got = V.top_k(v, q.select("query_id", F.col("__q").alias("query_vector")), 5, vector_col="v", exclude_self=True)
    assert sorted(map(repr, got.select("query_id", "id", "rank", "score").collect())) == want


def test_many_questions_read_chunks_once(spark):
    """Chunks were read once for each 2,048 questions."""
    repo = F.concat(F.lit("r"), (F.col("id") % 100).cast("string")).alias("repository_id")
    none = F.lit("").alias("content")
    chunks = spark.range(500).select(repo, F.format_string("f%d.py", "id").alias("file_path"), F.lit("function").alias("entity_type"), F.lit("f").alias("entity_name"), F.lit(1).alias("start_line"), none, F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    chunks = materialize(chunks, "chunks_once")
    questions = spark.range(9000).select(F.col("id").alias("question_id"), repo, F.lit("").alias("question"))
    out = H.vector_items(questions, chunks, lambda c: F.array(F.lit(1.0), F.lit(0.5)), 2)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") <= 4
    assert out.count() == 18000
