"""Set-based ranking against a plain loop, and small operators' edges."""

import random

from pyspark.sql import functions as F

from stratagraph.functions.paths import glob_regex
from stratagraph.operators import evaluation as E
from stratagraph.operators import ranking as R
from stratagraph.operators import traverse as T
from stratagraph.plans import scratch


def loop(items, limit, cap):
    items = sorted(items, key=lambda i: (-i["w"], i["tier"], i["file"], i["seq"]))
    kept = []
    for i in items:
        if not any(o["file"] == i["file"] and o["s"] <= i["s"] and o["e"] >= i["e"] for o in kept):
            kept.append(i)
    chosen, over, n = [], [], {}
    for i in kept:
        if n.get(i["file"], 0) >= cap:
            over.append(i)
        else:
            chosen.append(i)
            n[i["file"]] = n.get(i["file"], 0) + 1
    return [i["seq"] for i in (chosen + over)[:limit]]


def test_rank_equals_loop(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for q in range(60):
        items = []
        for seq in range(rng.randint(0, 25)):
            s = rng.randint(1, 30)
            tier, score = rng.randint(0, 5), rng.choice([0.0, 0.2, 0.5, 0.9])
            i = {"file": rng.choice("ab"), "s": s, "e": s + rng.randint(0, 20), "tier": tier, "seq": seq, "w": round(R.TIER_WEIGHTS[tier] * max(score, 0.01), 9)}
            items.append(i)
            rows.append((q, i["file"], "function", f"n{seq}", i["s"], i["e"], "", "", score, "vector", tier, "", "", seq))
        want[q] = loop(items, 8, 3)
    schema = "question_id int, file_path string, entity_type string, entity_name string, start_line int, end_line int, content string, language string, score double, source string, tier int, relationship string, reason string, seq int"
    got = {}
    for r in R.rank(spark.createDataFrame(rows, schema), 8, 3).orderBy("question_id", "position").collect():
        got.setdefault(r.question_id, []).append(r.seq)
    # Unlike the loop, backfilled items come after all others, as in the loop's own order.
    assert {q: w for q, w in want.items() if w} == got


def test_merge_relationships(spark):
    df = spark.createDataFrame([(["a b", "a", "c", "", None, "b c"],)], "x array<string>")
    assert df.select(R.merge_relationships(F.col("x"))).first()[0] == "a b, c, b c"


def test_chains(spark):
    edges = spark.createDataFrame([(1, 2), (2, 4), (1, 3), (3, 4), (4, 1), (4, 5)], "src long, dst long")
    pairs = spark.createDataFrame([(1, 5), (5, 1), (1, 4)], "source long, target long")
    got = {(r.source, r.target): (r.length, list(r.path)) for r in T.shortest_chains(edges, pairs).collect()}
    assert got == {(1, 5): (3, [1, 2, 4, 5]), (1, 4): (2, [1, 2, 4])}
    lone = T.ball(edges, spark.createDataFrame([(9,)], "id long"), 2).collect()
    assert [(r.id, r.hops) for r in lone] == [(9, 0)]


def test_globs():
    import fnmatch
    import re

    for g in ("*.min.js", "a?c", "[ab].py", "[!x]y", "a.b", "x[1"):
        for s in ("q.min.js", "abc", "a.py", "zy", "xy", "a.b", "axb", "x[1"):
            assert bool(re.fullmatch(glob_regex(g), s)) == fnmatch.fnmatchcase(s, g), (g, s)


def test_metrics_of_judged_rows(spark):
    """Counts of relevant files stand for lists of them."""
    retrieved = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 2, "y"), ("a", 1, 2, "x"), ("b", 2, 1, "q")], "system string, question_id int, position int, file_path string")
    questions = spark.createDataFrame([(1, "c", ["y", "z"]), (2, "c", []), (3, "d", ["q"])], "question_id int, category string, relevant_files array<string>")
    judged = E.ranked_files(retrieved).withColumn("hit", F.col("file_path") == "y")
    counted = questions.select("question_id", "category", F.size("relevant_files").alias("relevant"))
    got = E.judged_metrics(judged, counted, retrieved.select("system").distinct())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, E.question_metrics(retrieved, questions).collect()))
    one = got.where("system = 'a' and question_id = 1").first()
    assert (one.recall_at_1, one.recall_at_3, one.precision_at_5, one.mrr) == (0.0, 0.5, 0.5, 0.5)


def test_tasks_grow_in_number(spark, monkeypatch):
    """Containment is sorted in as many tasks as the rows ask for; before, in the session's number of partitions."""
    monkeypatch.setattr(scratch, "TASK_ROWS", 50)
    items = spark.range(2000).selectExpr("id % 20 question_id", "'a' file_path", "'f' entity_type", "concat('e', id) entity_name", "cast(id as int) start_line", "cast(id + 1 as int) end_line", "'' content", "'' language", "0.5D score", "'vector' source", "0 tier", "'' relationship", "'' reason", "id seq")
    kept = R.remove_contained(R.ordered(R.merge_duplicates(items)))
    assert "hashpartitioning(question_id" in kept._jdf.queryExecution().executedPlan().toString() and ", 40), REPARTITION_BY_NUM" in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 2000
