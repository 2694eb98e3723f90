"""Inverted-file vector search (V5): vectors in lists by their nearest centroid, of which a query opens a few.

Centroids are fitted by spherical k-means on a bounded sample of the vectors (SAMPLE, the smallest hashes of their ids), then every vector is
assigned to the nearest one and the lists are written as partitions. A query's probes are its nearest centroids; the
scan reads the partitions that some query probes and no others, and scores there are exact.

`search` is approximate: its recall grows with the probes. `search_exact` gives what a search of all vectors gives: each list
keeps the widest angle between its centroid and its vectors, so no vector of a list is nearer to a query than the angle to the
centroid less that width. After the first probes, the lists that could still hold one better than the k-th hit are read too.

A list may hold any share of the vectors: it is written by several tasks, read in splits, and never gathered in one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratagraph.operators import vector_search as V
from stratagraph.operators.vector_search import top_k
from stratagraph.plans.scratch import materialize, shared_dir

#: Vectors that the centroids are fitted on, at most; rounds of k-means; rows of a task's write of one list.
SAMPLE, ROUNDS, ROWS = 20_000, 12, 1 << 20
#: By how much scores of 6 places, and angles made from them, may be off.
_SLACK = 2e-6


@dataclass(frozen=True)
class Index:
    """centroids: a unit row a list; widths: the widest angle of each list, with `n` vectors each."""

    path: str
    schema: T.StructType
    centroids: np.ndarray
    widths: np.ndarray
    sizes: np.ndarray

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n > 0, n, 1.0)


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Vectors as rows; those of another length, or with nulls, as zeros."""
    flat, ends = column.values.to_numpy(zero_copy_only=False).astype(float), np.asarray(column.offsets)
    out = np.zeros((len(column), dim))
    fits = np.flatnonzero((np.diff(ends) == dim) & np.asarray(column.is_valid()))
    out[fits] = flat[ends[fits, None] + np.arange(dim)]
    return np.nan_to_num(out)


def fit_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Unit centroids by spherical k-means; starts are spread by distance. Deterministic."""
    x = _unit(sample)
    x = x[(x != 0).any(axis=1)]
    if not len(x):
        return np.zeros((1, sample.shape[1]))
    r = np.random.default_rng(0)
    chosen, far = [int(r.integers(len(x)))], np.full(len(x), np.inf)
    while len(chosen) < min(lists, len(x)):
        far = np.minimum(far, 1 - x @ x[chosen[-1]])
        weight = np.maximum(far, 0)
        if not weight.sum() > 1e-12:
            break
        chosen.append(int(r.choice(len(x), p=weight / weight.sum())))
    c = x[chosen]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        new = np.zeros_like(c)
        np.add.at(new, near, x)
        new = np.where((new != 0).any(axis=1, keepdims=True), _unit(new), c)
        if np.allclose(new, c, atol=1e-9):
            break
        c = new
    return c


def build(vectors: DataFrame, lists: int | None = None, id_col: str = "id", vector_col: str = "embedding", sample: int = SAMPLE) -> Index:
    """Index all vectors. `lists` is about the root of their number unless given.

    A null vector is left out. Zero vectors are in the first list. Columns other than id and vector are kept for filters.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0))
    taught = rows.select(F.col(vector_col).cast("array<double>").alias("v")).orderBy(F.xxhash64(F.col(id_col))).limit(sample)
    taught = [r["v"] for r in taught.collect()]  # at most `sample` rows
    n = rows.count()
    lists = lists or max(1, min(4096, round(n**0.5)))
    dim = max((len(v) for v in taught), default=1)
    fitted = np.array([[np.nan if a is None else a for a in v] for v in taught if len(v) == dim], float).reshape(-1, dim)
    centroids = fit_centroids(np.nan_to_num(fitted), lists)
    names = [f.name for f in rows.schema]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(_matrix(b.column(len(names)), dim))
            near = x @ centroids.T
            best = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(x)), best], -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(best, pa.int32()), pa.array(angle)], names=[*names, "list", "angle"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    path = f"{shared_dir(spark)}/inverted_file"
    told = rows.withColumn("__v", F.col(vector_col).cast("array<double>")).mapInArrow(assign, f"{kinds}, list int, angle double")
    # A list's rows go to as many tasks as its size asks for; a hot one is dealt out by the hash of its rows' ids.
    salt = F.pmod(F.xxhash64(id_col), F.lit(max(1, n // ROWS)))
    told.repartition("list", salt).write.partitionBy("list").option("maxRecordsPerFile", ROWS).parquet(path)
    schema = told.schema
    told = spark.read.schema(schema).parquet(path)
    widths, sizes = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in told.groupBy("list").agg(F.max("angle").alias("w"), F.count("*").alias("n")).collect():  # a row a list
        widths[r["list"]], sizes[r["list"]] = r["w"], r["n"]
    return Index(path, schema, centroids, widths, sizes)


def _probes(index: Index, queries: DataFrame, choose) -> DataFrame:
    """queries with `list`, a row for each list that `choose`(angles of all queries to all centroids, kth score or null) opens."""
    dim = index.centroids.shape[1]
    names = queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("query_vector")
            x = _unit(_matrix(b.column(at).cast(pa.list_(pa.float64())), dim))
            angles = np.arccos(np.clip(x @ index.centroids.T, -1, 1))
            kth = b.column(b.schema.get_field_index("kth")).to_numpy(zero_copy_only=False) if "kth" in names else None
            q, lists = np.nonzero(choose(angles, kth))
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(q)) for c in b.columns], pa.array(lists, pa.int32())], names=[*names, "list"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(run, f"{kinds}, list int")


def _scored(index: Index, asked: DataFrame, probes: DataFrame, k: int, id_col: str, vector_col: str, where, exclude_self: bool) -> DataFrame:
    """(query_id, id, rank, score) of the k nearest in the lists that each query opens. Only those partitions are read.

    A list's vectors and the queries that open it meet in bounded cells.
    """
    spark = probes.sparkSession
    probes = materialize(probes.select("query_id", "list"), "probes")
    opened = [r[0] for r in probes.select("list").distinct().collect()]  # lists, of which there are few thousand
    rows = index.rows(spark).where(F.col("list").isin(opened)) if opened else index.rows(spark).limit(0)
    rows = rows if where is None else rows.where(where)
    rows = rows.select("list", F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("__v"))
    pairs = probes.join(asked.select("query_id", F.col("query_vector").cast("array<double>").alias("__q"), F.lit(k).alias("__k")), "query_id")
    scored = V.nearest(rows, pairs, ["id"], "list", "id" if exclude_self else None)
    scored = scored.where(F.col("id") != F.col("query_id")) if exclude_self else scored
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "rank", "score")


def nearest(count: int):
    """Open the `count` nearest lists."""

    def choose(angles: np.ndarray, kth) -> np.ndarray:
        out = np.zeros(angles.shape, bool)
        np.put_along_axis(out, np.argsort(angles, axis=1, kind="stable")[:, :count], True, axis=1)
        return out

    return choose


def probes_for(index: Index, vectors: DataFrame, recall: float = 0.95, k: int = 10, id_col: str = "id", vector_col: str = "embedding", queries: int = 200) -> int:
    """The fewest probes by which a bounded sample of the vectors (`queries`, by hash of their ids) finds that share of its k nearest others."""
    asked = vectors.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(F.lit("asked"), F.col(id_col))).limit(queries)
    asked = materialize(asked.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("query_vector")), "sample_queries")
    hits = top_k(vectors.where(F.col(vector_col).isNotNull()), asked, k, id_col, vector_col, exclude_self=True)
    lists = index.rows(vectors.sparkSession).select(F.col(id_col).alias("id"), "list")
    found = lists.join(F.broadcast(hits.select("query_id", "id")), "id").join(F.broadcast(asked), "query_id").select("query_vector", "list").collect()  # queries x k rows at most
    if not found:
        return 1
    x = _unit(np.array([r["query_vector"] for r in found], float))
    angles = -(x @ index.centroids.T)
    own = angles[np.arange(len(x)), [r["list"] for r in found]]
    before = np.sort((angles < own[:, None]).sum(axis=1))
    return int(before[min(len(before) - 1, int(np.ceil(recall * len(before))))]) + 1


def search(index: Index, queries: DataFrame, k: int, probes: int, id_col: str = "id", vector_col: str = "embedding", where=None, exclude_self: bool = False) -> DataFrame:
    """(query_id, id, rank, score) of queries(query_id, query_vector) among the vectors of the `probes` nearest lists, as `vector_search.top_k` gives them."""
    asked = queries.select("query_id", "query_vector")
    return _scored(index, asked, _probes(index, asked, nearest(probes)), k, id_col, vector_col, where, exclude_self)


def search_exact(index: Index, queries: DataFrame, k: int, probes: int, id_col: str = "id", vector_col: str = "embedding", where=None, exclude_self: bool = False) -> DataFrame:
    """What `vector_search.top_k` gives over all indexed vectors: lists that the bound rules out for every query are not read.

    A query that finds fewer than k in its first lists opens all. Zero queries and zero vectors score 0 and are bound like others
    at a right angle, so they open and are found in every list that could hold a score of 0.
    """
    asked = materialize(queries.select("query_id", "query_vector"), "asked_vectors")
    first = materialize(search(index, asked, k, probes, id_col, vector_col, where, exclude_self), "first_hits")
    kth = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    widths, filled = index.widths, index.sizes > 0

    def could_hold(angles: np.ndarray, kth: np.ndarray) -> np.ndarray:
        best = np.cos(np.maximum(angles - widths, 0))
        # Zero vectors are assigned at a right angle to their centroid but score 0 from everywhere.
        best = np.maximum(best, np.where(widths >= np.pi / 2 - 1e-9, 0.0, -1.0))
        bar = np.where(np.isnan(kth.astype(float)), -2.0, kth.astype(float))
        return (best >= bar[:, None] - _SLACK) & filled

    told = asked.join(kth, "query_id", "left")
    return _scored(index, asked, _probes(index, told, could_hold), k, id_col, vector_col, where, exclude_self)
