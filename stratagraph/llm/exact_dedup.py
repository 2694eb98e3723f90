"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Native: DataFrame functions only. The text itself is never shuffled. A first scan counts lengths; a second one hashes
the prefixes of rows whose length is shared; a third one hashes the full text of rows whose (length, prefix) is
shared. What survives a step is marked in a bitmap of fixed size, so a bit set by accident only costs one more hash.
Groups are equal SHA-256 digests of the normalised text.

A group's verdict comes back to its rows by a shuffled join, but for hot groups: see `common.with_groups`.

Defined results
- A null text counts as empty, so all null and empty texts are one group.
- Ties: the smallest id stays. A null id is larger than any other.
- Repeated rows (same id, same text): one of them stays, the first in the input. An id over several texts: each text
  is decided by itself.
- Empty table: no rows. Extra columns of the input are ignored unless carried, whatever their names. Very long texts are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, bitmap_of, filter_by_ids, materialize, text_of, with_bit, with_groups


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(text_of(text), WS, " ")


def _digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 128,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, and the carried expressions.

    carry: extra output columns, computed over `__norm` (the normalised text) in the last scan.
    """
    carry = carry or {}
    keyed = docs.select(F.col(id_col).alias("__id"), normalised(text_col).alias("__norm")).withColumn("__len", F.length("__norm"))
    prefix = F.xxhash64("__len", F.substring("__norm", 1, prefix_chars))

    lengths = keyed.groupBy("__len").agg(F.count("*").alias("__n")).where("__n > 1")
    same_length = with_bit(keyed, "__len", materialize(bitmap_of(lengths, "__len"), "lengths"), "__same_length")
    prefixed = same_length.withColumn("__prefix", F.when(F.col("__same_length"), prefix))
    prefixes = prefixed.where("__prefix is not null").groupBy("__prefix").agg(F.count("*").alias("__n")).where("__n > 1")
    marked = with_bit(prefixed, "__prefix", materialize(bitmap_of(prefixes, "__prefix"), "prefixes"), "__marked")
    again = F.col("__same_length") & F.col("__marked")
    rows = marked.select(
        "__id", F.monotonically_increasing_id().alias("__row"), F.when(again, _digest(F.col("__norm"))).alias("__full"), *[c.alias(name) for name, c in carry.items()]
    )
    rows = materialize(rows, "exact_rows")
    return _verdicts(rows).select(
        F.col("__id").alias(id_col),
        F.when(F.col("__size").isNull(), F.col("__id")).otherwise(F.col("__keep.id")).alias("keep_id"),
        F.coalesce("__size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("__size").isNull() | (F.col("__row") == F.col("__keep.row"))).alias("kept"),
        *carry,
    )


def _verdicts(rows: DataFrame) -> DataFrame:
    """rows(__full, __id, __row, ...) with __size and __keep of their group, null where they are alone."""
    least = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row"))
    groups = rows.where("__full is not null").groupBy("__full").agg(F.count("*").alias("__size"), F.min(least).alias("__keep")).where("__size > 1")
    groups = materialize(groups, "exact_groups")
    return with_groups(rows, groups, "__full", "__size")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    What goes is removed by an anti join on the id. Rows of ids that have both rows that stay and rows that go, and
    rows without id, are told apart by their text's hash.
    """
    verdicts = materialize(exact_dedup(docs, id_col, text_col, carry={"__hash": _digest(F.col("__norm"))}).select(id_col, "kept", "__hash"), "exact_verdicts")
    dropped = verdicts.where("not kept")
    gone = materialize(dropped.where(F.col(id_col).isNotNull()).select(id_col).distinct(), "exact_gone")
    out = filter_by_ids(docs, gone, id_col, "left_anti")
    mixed = materialize(gone.join(verdicts.where("kept").select(id_col).distinct(), id_col, "left_semi"), "exact_mixed")
    nulls = dropped.where(F.col(id_col).isNull()).limit(1).count() > 0
    if not nulls and not mixed.limit(1).count():
        return out
    cols = docs.columns
    odd = docs.join(mixed, id_col, "left_semi").select(*cols)
    if nulls:
        out, odd = out.where(F.col(id_col).isNotNull()), odd.unionByName(docs.where(F.col(id_col).isNull()))
    odd = materialize(odd.withColumn("__hash", _digest(normalised(text_col))).withColumn("__row", F.monotonically_increasing_id()), "exact_odd")
    stay = verdicts.where("kept").select(F.col(id_col).alias("__kid"), F.col("__hash").alias("__khash")).distinct()
    first = odd.groupBy(F.col(id_col).alias("__i"), "__hash").agg(F.min("__row").alias("__row"))
    first = first.join(stay, F.col("__i").eqNullSafe(F.col("__kid")) & (F.col("__hash") == F.col("__khash")), "left_semi").select("__row")
    return out.select(*cols).unionByName(odd.join(first, "__row", "left_semi").select(*cols))
