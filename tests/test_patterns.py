"""Patterns against nested loops."""

import itertools
import random

import pytest

from stratagraph.operators import patterns as P


def by_hand(edges, pattern):
    names = sorted({v for a, _, b in pattern for v in (a, b)})
    nodes = sorted({x for s, d, _ in edges for x in (s, d)})
    have = set(edges)
    return sorted(bind for bind in itertools.product(nodes, repeat=len(names)) if all((bind[names.index(a)], bind[names.index(b)], r) in have for a, r, b in pattern))


def test_patterns_equal_loops(spark):
    r = random.Random(4)
    edges = sorted({(f"n{r.randrange(9)}", f"n{r.randrange(9)}", r.choice("xyz")) for _ in range(45)})
    df = spark.createDataFrame(edges + edges[:5], "src string, dst string, rel_type string")
    for pattern in ([("a", "x", "b")], [("a", "x", "b"), ("b", "y", "c")], [("a", "x", "b"), ("a", "y", "c"), ("a", "z", "d")], [("a", "x", "b"), ("b", "y", "c"), ("c", "z", "a")], [("a", "x", "b"), ("b", "x", "a")], [("a", "x", "a"), ("a", "y", "b")], [("a", "none", "b"), ("b", "x", "c")]):
        got = P.match(df, pattern)
        assert got.columns == sorted(got.columns) and sorted(map(tuple, got.collect())) == by_hand(edges, pattern), pattern
    for bad in ([], [("a", "x", "b"), ("c", "y", "d")]):
        with pytest.raises(ValueError):
            P.match(df, bad)


def test_joins_start_small_and_close_early():
    counts = {"big": P.Counts(10_000, 10, 5_000), "mid": P.Counts(500, 400, 20), "rare": P.Counts(3, 3, 3)}
    assert P.order([("a", "big", "b"), ("b", "mid", "c"), ("c", "rare", "d")], counts) == [("c", "rare", "d"), ("b", "mid", "c"), ("a", "big", "b")]
    assert P.order([("a", "rare", "b"), ("b", "big", "c"), ("a", "mid", "b")], counts)[1] == ("a", "mid", "b")
