"""Bitmaps of row numbers, made by Spark's bitmap aggregates: bucket and place of a row, and the test of a bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a bucket's bitmap; a bucket covers eight rows a byte.
BUCKET_BYTES = 4096


def bucket(row: Column) -> Column:
    """Bucket of a row number that counts from 0."""
    return F.bitmap_bucket_number(row + 1)


def place(row: Column) -> Column:
    return F.bitmap_bit_position(row + 1)


def has_bit(bits: Column, at: Column) -> Column:
    """The bit at that place is set; false where there is no bitmap."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
