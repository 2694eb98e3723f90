"""Helpers that the training-data operators share: input, folds, bitmaps, checked broadcasts, hot groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.plans.scratch import BROADCAST_ROWS, materialize

#: White space of every contract: space, and tab to carriage return.
WS = r"[\x20\x09-\x0D]+"
#: Bits of the broadcast bitmap (1 MB), whatever the input.
BITMAP_BITS = 1 << 23
#: Groups that are broadcast at most (about 10 MB), and rows below which a group is never called hot.
HOT_GROUPS, LEAST_HOT = 100_000, 200


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches hold about `size` bytes, unless the session sets a bound of its own: 10,000 whole texts would fill a worker.

    Spark has no such setting for a plan, so the session's is given one where it has none; results do not depend on it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, size)


def text_of(column: str | Column) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold_of(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def bitmap_of(keys: DataFrame, key: str) -> DataFrame:
    """Fixed-size bitmap of the hashes of a column: at most BITMAP_BITS / 32768 rows of 4 KB, built by Spark."""
    slot = F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS))
    return (
        keys.select(slot.alias("__slot"))
        .groupBy(F.bitmap_bucket_number("__slot").alias("__bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("__slot")).alias("__bits"))
    )


def with_bit(df: DataFrame, key: str, bitmap: DataFrame, flag: str) -> DataFrame:
    """Add boolean flag: the key's bit is set (always for members, seldom for others). No shuffle of df."""
    slot = F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS))
    pos = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__pos div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return (
        df.withColumn("__bucket", F.bitmap_bucket_number(slot))
        .withColumn("__pos", pos)
        .join(F.broadcast(bitmap), "__bucket", "left")
        .withColumn(flag, F.coalesce(F.getbit(byte, (F.col("__pos") % 8).cast("int")) == 1, F.lit(False)))
        .drop("__bucket", "__bits", "__pos")
    )


def filter_by_ids(docs: DataFrame, ids: DataFrame, id_col: str, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """left_semi or left_anti on an id; ids (one column of that name) must be cheap to count twice.

    Broadcast only when counted to at most `limit` rows; otherwise a sort-merge join that AQE may split.
    """
    n = ids.limit(limit + 1).count()
    side = F.broadcast(ids) if n <= limit else ids
    return docs.join(side, id_col, how)


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows with the columns of groups(key, size, ...) of their group, null where they have none. Both are written and read again.

    Groups of over 1 / HOT_GROUPS of all rows, of which there are fewer than HOT_GROUPS, are broadcast; so no key of
    the shuffle that brings the others back holds more rows than that. Rows without a key take no part.
    """
    bar = max(LEAST_HOT, -(-rows.count() // HOT_GROUPS))
    more = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) > bar).select(key, F.struct(*more).alias("__hot"))
    told = rows.join(F.broadcast(hot), key, "left")
    is_hot = F.col(f"__hot.{size}").isNotNull()
    done = told.where(is_hot).select(*rows.columns, *[f"__hot.{c}" for c in more])
    kinds = {f.name: f.dataType for f in groups.schema}
    alone = rows.where(F.col(key).isNull()).select(*rows.columns, *[F.lit(None).cast(kinds[c]).alias(c) for c in more])
    rest = told.where(F.col(key).isNotNull() & ~is_hot).select(*rows.columns).join(groups.where(F.col(size) <= bar), key, "left")
    columns = [*rows.columns, *more]
    return done.select(*columns).unionByName(alone.select(*columns)).unionByName(rest.select(*columns))
