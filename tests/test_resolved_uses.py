"""Definitions are counted by file before they meet uses, and calls keep their rows where all of them are asked for."""

from stratagraph.operators import changes as D
from stratagraph.operators import resolution as R


def _rows(spark):
    e = spark.createDataFrame([("r", k, "b.py", "function", "f") for k in range(50)] + [("r", 60, "c.py", "method", "g"), ("r", 61, "d.py", "function", "h"), ("r", 62, "e.py", "function", "h")], "repository_id string, seq long, file_path string, entity_type string, entity_name string")
    i = spark.createDataFrame([("r", f"a{k}.py", "b.py") for k in range(20)] + [("r", "a0.py", "d.py")], "repository_id string, source_file string, resolved_file string")
    c = spark.createDataFrame([("r", 1, "a0.py", "x", "f"), ("r", 2, "a1.py", "x", "g"), ("r", 3, "a0.py", "x", "h"), ("r", 4, "c.py", "g", "g"), ("r", 5, "b.py", "x", "f"), ("r", 6, "a2.py", "x", "h"), ("r", 7, "a2.py", "x", "print"), ("r", 8, "a2.py", "x", None)], "repository_id string, seq long, caller_file string, caller_name string, callee_name string")
    return e, i, c


def test_every_call_keeps_its_row(spark):
    e, i, c = _rows(spark)
    got = {r["seq"]: (r["callee_file"], r["callee_type"]) for r in R.resolve_calls(c, e, i, every=True).collect()}
    # 50 definitions in an imported file are no target; one elsewhere, or in an imported file, is; recursion is none.
    assert got == {1: (None, None), 2: ("c.py", "method"), 3: ("d.py", "function"), 4: (None, None), 5: ("b.py", "function"), 6: (None, None), 7: (None, None), 8: (None, None)}
    assert {r["seq"] for r in R.resolve_calls(c, e, i).collect()} == {2, 3, 5}


def test_stale_rows_are_told_in_one_pass(spark):
    _, _, c = _rows(spark)
    names = spark.createDataFrame([("r", "f"), ("r", "f")], "repository_id string, name string")
    sources = spark.createDataFrame([("r", "a2.py")], "repository_id string, source_file string")
    told = D.with_stale(c, "callee_name", "caller_file", names, sources)
    assert sorted((r["seq"], r["stale"]) for r in told.collect()) == [(1, True), (2, False), (3, False), (4, False), (5, True), (6, True), (7, True), (8, True)]
    assert told._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 0  # the uses are not shuffled
