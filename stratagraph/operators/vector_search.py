"""Filtered cosine top-k over stored vectors (V5-V7)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratagraph.plans.scratch import materialize

DIRECT_RANKS = 3
TIER_DIRECT, TIER_RELATED, TIER_DEPENDENCY, TIER_FILE, TIER_DOCUMENTATION, TIER_CONTEXT = range(6)
#: Stored vectors and query vectors of one cell, about; both bound what one task holds.
CELL_ROWS, CELL_QUERIES = 4096, 1024
#: By how much a score in single precision and one rounded to 6 places may be off together.
_SLACK = 1e-5


def _fold(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of rows, added from the left in double precision."""
    return np.cumsum(x * y, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _matrix(column: pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of that length as rows, which rows those are); others, and those with nulls, are not told apart."""
    column = column.combine_chunks()
    column = column if isinstance(column, pa.ListArray) else pa.concat_arrays(column.chunks)
    flat, ends = column.values, np.asarray(column.offsets)
    whole = np.asarray(column.is_valid()) & (np.diff(ends) == dim)
    nulls = np.concatenate([[0], np.cumsum(np.asarray(flat.is_null()))]) if flat.null_count else None
    whole = whole if nulls is None else whole & (nulls[ends[1:]] == nulls[ends[:-1]])
    at = np.flatnonzero(whole)
    return flat.to_numpy(zero_copy_only=False)[ends[at, None] + np.arange(dim)].astype(float), at


def _lengths(x: np.ndarray) -> np.ndarray:
    n = np.sqrt(_fold(x, x))
    return np.where(n == 0, 1.0, n)


def _best(rows: np.ndarray, queries: np.ndarray, k: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) that can be among each query's k best rows; rows come in the order that decides ties, own is the row that a query may not find (-1: none).

    Products in single precision leave out what is too far below the k-th; scores of the rest are exact. Of equal scores only the first k are kept.
    """
    with np.errstate(all="ignore"):
        n, qn = _lengths(rows), _lengths(queries)
        unit, asked = (rows / n[:, None]).astype(np.float32), (queries / qn[:, None]).astype(np.float32)
        odd = ~np.isfinite(unit).all(axis=1)
        near = asked @ np.where(odd[:, None], 0, unit).T
        near[:, odd] = -np.inf
        has = np.flatnonzero(own >= 0)
        near[has, own[has]] = -np.inf
        bar = np.full(len(queries), -np.inf)
        for kk in np.unique(k[k < len(rows)]):
            some = np.flatnonzero(k == kk)
            bar[some] = np.partition(near[some], len(rows) - kk, axis=1)[:, len(rows) - kk]
        take = ~(near < (bar - _SLACK)[:, None]) | odd
        take[has, own[has]] = False
        q, r = np.nonzero(take)
        score = np.concatenate([_fold(queries[q[i : i + CELL_ROWS]], rows[r[i : i + CELL_ROWS]]) for i in range(0, len(q), CELL_ROWS)] or [np.zeros(0)]) / (qn[q] * n[r])
    at = np.lexsort((r, -score, q))
    q, r, score = q[at], r[at], score[at]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (score[1:] != score[:-1])
    place = np.arange(len(q))
    place -= np.maximum.accumulate(np.where(new, place, 0))
    kept = place < k[q]
    return q[kept], r[kept], score[kept]


def _search(order: list[str], exclude: str | None, names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The search of one cell: rows with __v and __by, queries with __q, __by and __k."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order], null_placement="at_start"))
        groups = pc.unique(queries["__by"].combine_chunks())
        ends = lambda c: [np.flatnonzero(np.asarray(pc.index_in(c, value_set=groups).fill_null(-1)) == g) for g in range(len(groups))]
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool))]
        sizes = np.asarray(pc.fill_null(pc.list_value_length(queries["__q"]), -1)) if len(queries) else np.zeros(0, int)
        k = np.asarray(queries["__k"])
        for here, there in zip(ends(rows["__by"]), ends(queries["__by"])) if len(rows) else ():
            part = rows["__v"].take(pa.array(here))
            for dim in np.unique(sizes[there]):
                asked = there[sizes[there] == dim]
                x, at = _matrix(part, max(dim, 0))
                y, fits = _matrix(queries["__q"].take(pa.array(asked)), max(dim, 0))
                own = np.full(len(asked), -1)
                if exclude:
                    ids = rows[exclude].take(pa.array(here[at])).combine_chunks()
                    own = np.asarray(pc.index_in(queries["__self"].take(pa.array(asked)), value_set=ids).fill_null(-1))
                if len(at) and len(fits):
                    q, r, score = _best(x, y, k[asked[fits]], own[fits])
                    found.append((asked[fits[q]], here[at[r]], score, np.zeros(len(q), bool)))
                # A pair whose lengths differ, or with a null, has no score and comes last.
                lost = np.setdiff1d(np.arange(len(here)), at)
                for some, unscored in ((fits, lost), (np.setdiff1d(np.arange(len(asked)), fits), np.arange(len(here)))):
                    for a in asked[some] if len(unscored) else ():
                        none = unscored[: k[a] + 1]
                        found.append((np.full(len(none), a), here[none], np.zeros(len(none)), np.ones(len(none), bool)))
        q, r, score, null = (np.concatenate(c) for c in zip(*found))
        left, right = rows.take(pa.array(r, pa.int64())), queries.take(pa.array(q, pa.int64()))
        return pa.table({c: left[c] if c in left.column_names else pa.array(score, mask=null) if c == "__score" else right[c] for c in names})

    return run


def nearest(rows: DataFrame, queries: DataFrame, order: list[str], by: str | None = None, exclude: str | None = None) -> DataFrame:
    """For each of queries(query_id, __q, __k, `by`) the rows (`by`, __v, others) that can be among its __k best ones of the same `by`, with `score` to 6 places.

    Rows and queries meet in cells of bounded size: buckets of `by` hold about CELL_ROWS rows, and one that holds more rows or
    queries is dealt out by their hashes. A task holds one cell; nothing goes through the driver. Ties go by `order`.
    """
    key = F.lit(0) if by is None else F.col(by)
    rows, queries = (df.withColumn("__by", key).where("__by is not null") for df in (rows, queries))
    parts = max(1, -(-rows.count() // CELL_ROWS)) if by else 1
    cell = F.pmod(F.xxhash64("__by"), F.lit(parts)).alias("__c")
    upto = lambda n, most: F.ceil(n / most).cast("int")
    sizes = rows.groupBy(cell).agg(F.count("*").alias("n")).join(queries.groupBy(cell).agg(F.count("*").alias("m")), "__c")
    sizes = F.broadcast(materialize(sizes.select("__c", upto(F.col("n"), CELL_ROWS).alias("__rs"), upto(F.col("m"), CELL_QUERIES).alias("__qs")), "cells"))
    dealt = lambda n, *c: F.pmod(F.xxhash64(F.lit(7), *c), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    held = rows.withColumn("__c", cell).join(sizes, "__c").withColumn("__r", dealt("__rs", *order)).withColumn("__s", all_of("__qs")).drop("__rs", "__qs")
    asked = queries.withColumn("__c", cell).join(sizes, "__c").withColumn("__s", dealt("__qs", "query_id")).withColumn("__r", all_of("__rs")).drop("__rs", "__qs")
    hidden = {"__v", "__q", "__k", "__by", "__c", "__r", "__s", "__self"}
    fields = [f for f in held.schema if f.name not in hidden]
    fields += [f for f in asked.schema if f.name not in hidden | {f.name for f in fields}]
    schema = T.StructType([*fields, T.StructField("__score", T.DoubleType())])
    if exclude:
        asked = asked.withColumn("__self", F.col("query_id").cast(rows.schema[exclude].dataType))
    at = ["__c", "__r", "__s"]
    found = held.groupBy(*at).cogroup(asked.groupBy(*at)).applyInArrow(_search(order, exclude, schema.names), schema)
    return found.withColumn("score", F.round("__score", 6)).drop("__score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding", where=None, exclude_self: bool = False) -> DataFrame:
    """V5: (query_id, id, rank, score) of the k nearest rows for each of queries(query_id, query_vector).

    Filters apply before any vector is read. A cell sends k rows a query, and the rank filter becomes a group limit below the
    shuffle. Scores are rounded to 6 places; ties go to the smaller id.
    """
    rows = vectors if where is None else vectors.where(where)
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("__v"))
    asked = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("__q"), F.lit(k).alias("__k"))
    scored = nearest(rows, asked, ["id"], exclude="id" if exclude_self else None)
    scored = scored.where("id <> query_id") if exclude_self else scored
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "rank", "score")


def with_tier(hits: DataFrame, entity_type=None) -> DataFrame:
    """V7: documentation sections get their own tier, ranks up to 3 are direct, the rest count as file context."""
    doc = F.lit(False) if entity_type is None else F.col(entity_type) == "doc_section"
    return hits.withColumn("tier", F.when(doc, TIER_DOCUMENTATION).when(F.col("rank") <= DIRECT_RANKS, TIER_DIRECT).otherwise(TIER_FILE)).withColumn(
        "reason", F.format_string("semantic match, rank %d", "rank")
    )


def count_vectors(vectors: DataFrame, by: str) -> DataFrame:
    """V6."""
    return vectors.groupBy(by).agg(F.count("*").alias("n"))
