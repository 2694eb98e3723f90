"""Vector expressions: dot product, norm and cosine in double precision, hashing embedding, point ids."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the URL namespace of RFC 4122.
_URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def length(a: Column) -> Column:
    """The norm to divide by; a zero vector counts as length 1."""
    return F.coalesce(F.nullif(norm(a), F.lit(0.0)), F.lit(1.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity. Where pairs are many, keep the vectors' lengths and divide dot products by them."""
    return dot(a, b) / (length(a) * length(b))


def hashing_embedding(text: Column, dimension: int = 256) -> Column:
    """V3: character 3- and 4-grams of the lower-cased text, crc32 buckets, L2 normalised. Stable across processes.

    An Arrow UDF: built-in functions would walk the grams once a bucket. Null counts as empty; no gram gives zeros.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts.fillna("").str.lower():
            grams = [t[i : i + n].encode() for n in (3, 4) for i in range(len(t) - n + 1)]
            counts = np.bincount([zlib.crc32(g) % dimension for g in grams], minlength=dimension).astype(float) if grams else np.zeros(dimension)
            out.append((counts / (np.sqrt((counts * counts).sum()) or 1.0)).tolist())
        return pd.Series(out, dtype=object)

    return embed(text)


def uuid5(key: Column) -> Column:
    """V4: version 5 UUID in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(_URL_NAMESPACE)), F.encode(key, "utf-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(19, 2)), part(21, 12))
