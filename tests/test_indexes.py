"""Inverted files and bucketed graphs: recall, exactness, what is read, what is shuffled."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagraph.operators import graph as G
from stratagraph.operators import inverted_file as I
from stratagraph.operators import vector_search as V
from stratagraph.plans.tables import code_graph
from stratagraph.sources import adjacency as A

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


@pytest.fixture(scope="module")
def index(vectors):
    return I.build(vectors, id_col="vec_id")


def pairs(df):
    return {(r["query_id"], r["id"]) for r in df.collect()}


def test_every_vector_is_indexed_and_recall_holds(spark, vectors, index):
    assert index.rows(spark).count() == vectors.count() == index.sizes.sum() and len(index.centroids) > 10
    queries = vectors.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    probes = I.probes_for(index, vectors, 0.95, 10, "vec_id")
    want = pairs(V.top_k(vectors, queries, 10, "vec_id", exclude_self=True))
    found = pairs(I.search(index, queries, 10, probes, "vec_id", exclude_self=True))
    assert len(found & want) / len(want) >= 0.9
    assert len(pairs(I.search(index, queries, 10, 2, "vec_id", exclude_self=True)) & want) < len(found & want)


def clustered(spark, n=4000, groups=40, dim=16):
    r = np.random.default_rng(5)
    centres = r.normal(size=(groups, dim))
    x = centres[r.integers(0, groups, n)] + 0.05 * r.normal(size=(n, dim))
    return spark.createDataFrame([(k, v.tolist(), k % 3) for k, v in enumerate(x)], "id long, embedding array<double>, kind int")


def test_few_lists_are_read_where_vectors_cluster(spark):
    """Ten queries of one group: the exact search opens a few lists only, and Spark lists no other partition's files."""
    v = clustered(spark)
    ix = I.build(v, lists=40)
    first = v.where("id = 0").select("embedding").first()[0]
    asked = spark.createDataFrame([(-k - 1, [a * (1 + 1e-3 * k) for a in first]) for k in range(10)], "query_id long, query_vector array<double>")
    exact = I.search_exact(ix, asked, 5, 1)
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, V.top_k(v, asked, 5).collect()))
    filters = lambda df: re.findall(r"PartitionFilters: \[[^\]]*list#\d+[^\]]*\]", df._jdf.queryExecution().executedPlan().toString())
    assert filters(exact)
    (one,) = filters(I.search(ix, asked, 5, 1))
    assert re.search(r"list#\d+ (=|IN) \(?\d+\)", one), one  # a single list


def test_exact_search_with_filters_and_odd_vectors(spark):
    data = clustered(spark, 600, 6)
    odd = spark.createDataFrame([(1000, [0.0] * 16, 0), (1001, None, 0), (1002, [], 1), (1003, [1.0] * 16, 2), (1003, [1.0] * 16, 2)], "id long, embedding array<double>, kind int")
    v = data.unionByName(odd)
    ix = I.build(v, lists=8)
    assert ix.sizes.sum() == 603
    asked = data.where("id % 97 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector")).unionByName(spark.createDataFrame([(5000, [0.0] * 16)], "query_id long, query_vector array<double>"))
    whole = v.where("embedding is not null and size(embedding) > 0")
    for where, self_ in ((None, False), (F.col("kind") == 1, True)):
        got = sorted(map(tuple, I.search_exact(ix, asked, 7, 1, where=where, exclude_self=self_).collect()))
        assert got == sorted(map(tuple, V.top_k(whole, asked, 7, where=where, exclude_self=self_).collect()))


def test_index_of_nothing_and_of_equal_vectors(spark):
    empty = I.build(spark.createDataFrame([], "id long, embedding array<float>"))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_vector array<double>")
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(50)], "id long, embedding array<double>")
    assert empty.sizes.sum() == 0 and I.probes_for(empty, same.limit(0)) == 1
    ix = I.build(same, lists=5)
    assert len(ix.centroids) == 1 and [r["id"] for r in I.search_exact(ix, asked, 3, 1).orderBy("rank").collect()] == [0, 1, 2]


@pytest.fixture(scope="module")
def graph(spark):
    return code_graph(spark, SF)


@pytest.fixture(scope="module")
def adjacency(spark, graph, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("adjacency") / "index")
    A.write_index(graph, folder, 8)
    return A.open_index(spark, folder)  # as a later session would


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange hashpartitioning", plan)), plan


def test_one_hop_shuffles_no_edges(spark, graph, adjacency):
    ids = graph.nodes.where("node_type = 'Class'").select(F.col("node_id").alias("here"))
    ids = spark.createDataFrame(ids.collect(), ids.schema)
    for out, here in ((True, "src"), (False, "dst")):
        found = A.neighbours(adjacency, ids, out)
        n, plan = exchanges(found)
        assert n == 1 and "SortMergeJoin" in plan and "Bucketed: true" in plan
        want = graph.edges.join(ids.withColumnRenamed("here", here), here)
        assert sorted(map(tuple, found.collect())) == sorted((r[here], r["dst" if out else "src"], r["rel_type"]) for r in want.collect())


def test_a_level_shuffles_no_edges(spark, adjacency):
    """Both sides lie by the same key: nodes met with their edges need no shuffle at all."""
    nodes = adjacency.nodes.select(F.col("node_id").alias("here"), "name")
    found = nodes.hint("merge").join(adjacency.around(True), "here")
    n, plan = exchanges(found)
    assert n == 0 and "SortMergeJoin" in plan


def test_reach_equals_a_walk(spark, graph, adjacency):
    edges = {}
    for r in graph.edges.where("rel_type = 'FILE_IMPORTS_FILE'").collect():
        edges.setdefault(r["src"], set()).add(r["dst"])
    starts = graph.nodes.where("node_type = 'File'").select(F.col("node_id").alias("start"))
    got = {(r["start"], r["id"]): r["hops"] for r in A.reach(adjacency, starts, 2, rel_types=["FILE_IMPORTS_FILE"]).collect()}
    want = {}
    for (s,) in starts.collect():
        level, want[s, s] = {s}, 0
        for h in (1, 2):
            level = {d for x in level for d in edges.get(x, ())} - {i for (a, i) in want if a == s}
            want |= {(s, i): h for i in level}
    assert got == want


def test_index_of_an_empty_graph(spark, graph, tmp_path):
    index = A.write_index(G.Graph(graph.nodes.limit(0), graph.edges.limit(0)), str(tmp_path / "none"), 4)
    assert index.nodes.count() == 0 and A.reach(index, spark.createDataFrame([("x",)], "start string"), 3).collect() == [("x", "x", 0)]
