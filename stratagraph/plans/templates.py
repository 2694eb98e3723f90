"""Typed rows spread over the keys of a table, for queries whose input no table holds: questions, answers, paths, sources.

`{n}` in a text becomes the key, so every key has names and paths of its own, and the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.plans.scratch import spread
from stratagraph.plans.tables import table

#: Name and Spark type of each column.
Fields = list[tuple[str, str]]


def fields(schema: str) -> Fields:
    return [tuple(c.split()) for c in schema.split(", ")]


def _literal(v, kind: str) -> Column:
    return (F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)).cast(kind)


def _numbered(c: Column, kind: str, n: Column) -> Column:
    put = lambda x: F.replace(x, F.lit("{n}"), n.cast("string"))
    return put(c) if kind == "string" else F.transform(c, put) if kind == "array<string>" else c


def _keys(spark: SparkSession, d: str, name: str, key: str, times: int) -> DataFrame:
    """The keys, dealt out: a file of them is one task, whatever work their rows are."""
    keys = table(spark, d, name).select(F.col(key).alias("n"))
    return spread(keys, times * keys.count(), "n")


def each(spark: SparkSession, d: str, name: str, key: str, rows: list[tuple], schema: str, skip: int = 0) -> DataFrame:
    """n, k (the row's place) and the row's columns: all rows for each key, without those where n + k is a multiple of `skip`."""
    kinds = fields(schema)
    typed = F.array(*[F.struct(F.lit(k).alias("k"), *[_literal(v, t).alias(c) for v, (c, t) in zip(r, kinds)]) for k, r in enumerate(rows)])
    out = _keys(spark, d, name, key, len(rows)).select("n", F.explode(typed).alias("r")).select("n", "r.*")
    out = out.where((F.col("n") + F.col("k")) % skip != 0) if skip else out
    return out.select("n", "k", *[_numbered(F.col(c), t, F.col("n")).alias(c) for c, t in kinds])


def dealt(spark: SparkSession, d: str, name: str, key: str, rows: list[tuple], schema: str) -> DataFrame:
    """The same with one row for each key, by its remainder."""
    kinds = fields(schema)
    typed = F.array(*[F.struct(F.lit(k).alias("k"), *[_literal(v, t).alias(c) for v, (c, t) in zip(r, kinds)]) for k, r in enumerate(rows)])
    out = _keys(spark, d, name, key, 1).select("n", F.element_at(typed, (F.col("n") % len(rows) + 1).cast("int")).alias("r")).select("n", "r.*")
    return out.select("n", "k", *[_numbered(F.col(c), t, F.col("n")).alias(c) for c, t in kinds])


# The same in SQL -------------------------------------------------------------------------------------


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql(v, kind: str) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(quote(x) for x in v) + "]::VARCHAR[]"
    return quote(v) if isinstance(v, str) else str(v)


def _cte(alias: str, name: str, key: str, rows: list[tuple], schema: str, on: str) -> str:
    kinds = fields(schema)
    values = ", ".join("(" + ", ".join([str(k), *[_sql(v, t) for v, (_, t) in zip(r, kinds)]]) + ")" for k, r in enumerate(rows))
    put = lambda x: f"replace({x}, '{{n}}', CAST({key} AS VARCHAR))"
    shown = [put(c) if t == "string" else f"list_transform({c}, lambda x: {put('x')})" if t == "array<string>" else c for c, t in kinds]
    columns = ", ".join(f"{s} AS {c}" for s, (c, _) in zip(shown, kinds))
    return f"{alias} AS (SELECT {key} AS n, k, {columns} FROM {name} JOIN (SELECT * FROM (VALUES {values}) AS v(k, {', '.join(c for c, _ in kinds)})) ON {on})"


def each_sql(alias: str, name: str, key: str, rows: list[tuple], schema: str, skip: int = 0) -> str:
    return _cte(alias, name, key, rows, schema, f"({key} + k) % {skip} <> 0" if skip else "TRUE")


def dealt_sql(alias: str, name: str, key: str, rows: list[tuple], schema: str) -> str:
    return _cte(alias, name, key, rows, schema, f"{key} % {len(rows)} = k")
