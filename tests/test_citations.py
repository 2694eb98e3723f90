"""Citations are verified by a sweep as they are by comparing every pair; odd line numbers have a defined result."""

import random

import pytest

from stratagraph.operators import grounding as C

CITED = "question_id long, seq int, file_path string, start_line int, end_line int"
RANGES = "question_id long, file_path string, start_line int, end_line int"


@pytest.mark.parametrize("swept", [7, 4096])
def test_sweep_equals_pairs(spark, monkeypatch, swept):
    monkeypatch.setattr(C, "SWEPT_LINES", swept)
    rng = random.Random(swept)
    span = lambda: (lambda s: (s, s + rng.choice([-3, 0, 1, 4, 40])))(rng.randrange(1, 300))
    cited = [(rng.randrange(4), k, rng.choice("ab"), *span()) for k in range(400)] + [(None, 400, "a", 5, 6), (9, 401, "a", 5, 6)]
    found = [(rng.randrange(3), rng.choice("ab"), *span()) for _ in range(30)] + [(0, None, 1, 900), (None, "a", 1, 900), (1, "a", None, 900), (1, "a", 1, None)]
    got = {(r.question_id, r.file_path, r.start_line, r.end_line): (r.seq, r.verified) for r in C.verify(spark.createDataFrame(cited, CITED), spark.createDataFrame(found, RANGES)).collect()}
    want = {}
    for q, k, f, s, e in cited:
        meets = q is not None and any(q == rq and f == rf and None not in (rs, re) and s <= re + 5 and rs - 5 <= e for rq, rf, rs, re in found)
        want[q, f, s, e] = (min(k, want.get((q, f, s, e), (k,))[0]), meets)
    assert got == want and {v for _, v in got.values()} == {True, False}


def test_work_does_not_grow_with_the_product(spark):
    """60,000 citations and 60,000 ranges of one file: 3.6 billion pairs, which this would not end with."""
    line = "cast(id % 50000 * 7 + 1 as int)"
    cited = spark.range(60_000).selectExpr("1L as question_id", "cast(id as int) as seq", "'a.py' as file_path", f"{line} as start_line", f"{line} + 1 as end_line")
    found = spark.range(60_000).selectExpr("1L as question_id", "'a.py' as file_path", "cast(id * 14 + 1 as int) as start_line", "cast(id * 14 + 1 as int) as end_line")
    # Ranges are lines 14m + 1 and so reach 14m - 4 to 14m + 6; citations are 14m + 1 to 14m + 2, which meet one, and 14m + 8 to 14m + 9, which lie between two.
    assert sorted(map(tuple, C.verify(cited, found).groupBy("verified").count().collect())) == [(False, 25_000), (True, 25_000)]


def test_odd_numbers(spark):
    answers = spark.createDataFrame([(1, "See `a.py:99999999999` and a.py:3-99999999999, not a.py:7-2."), (2, None), (3, "")], "question_id long, answer string")
    found = C.extract(answers)
    assert sorted((r.start_line, r.end_line) for r in found.collect()) == [(3, C.LAST_LINE), (7, 2), (C.LAST_LINE, C.LAST_LINE)]
    judged = C.verify(found, spark.createDataFrame([(1, "a.py", 1, 4)], RANGES))
    assert {(r.start_line, r.verified) for r in judged.collect()} == {(3, True), (7, True), (C.LAST_LINE, False)}
    text = {r.question_id: r.answer for r in C.strip_unverified(answers, judged).collect()}
    assert text[1] == f"See a.py{C.UNVERIFIED} and a.py:3-99999999999, not a.py:7-2." and text[2] is None and text[3] == ""
