"""Containment by halving, two-ended paths, and isolated retrievers, against plain versions."""

import random
import time

from pyspark.sql import functions as F

from stratagraph.operators import facts as H
from stratagraph.operators import ranking as R
from stratagraph.operators import traverse as T

RANKED = "question_id int, file_path string, start_line int, end_line int, rnk int, name string"


def kept_by_hand(rows):
    """The greedy loop: an item goes if a better one of its question and file holds its lines."""
    out = []
    for q, f, s, e, r, n in rows:
        inside = any(q == q2 and f == f2 and r2 < r and s2 <= s and e2 >= e and s <= e2 and s2 <= e for q2, f2, s2, e2, r2, _ in rows)
        if not inside:
            out.append((q, f, s, e, r, n))
    return sorted(out)


def test_containment_equals_the_pairs(spark):
    r = random.Random(3)
    rows = []
    for q in range(6):
        for rank in range(1, 1 + r.choice([1, 2, 3, 17, 64, 65])):
            s = r.randrange(30)
            rows.append((q, f"f{r.randrange(2)}", s, s + r.randrange(-1, 12), rank, f"n{rank}"))
    got = sorted(map(tuple, R.remove_contained(spark.createDataFrame(rows, RANKED)).collect()))
    assert got == kept_by_hand(rows) and 0 < len(got) < len(rows)
    assert R.remove_contained(spark.createDataFrame([], RANKED)).count() == 0


def test_containment_in_one_hot_file(spark):
    """30,000 items of one file: half of them nested in the first one, half apart; pairs would be 900 million."""
    n = 30_000
    df = spark.range(n).select(F.lit(1).alias("question_id"), F.lit("f").alias("file_path"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.lit(0)).cast("int").alias("start_line"), F.when(F.col("id") % 2 == 0, F.col("id") + n).otherwise(n - F.col("id")).cast("int").alias("end_line"), (F.col("id") + 1).cast("int").alias("rnk"), F.lit("x").alias("name"))
    began = time.time()
    kept = R.remove_contained(df)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    # The even ones start and end later and later, and the first of them holds all odd ones.
    assert kept.count() == n // 2 and kept.where("rnk % 2 = 0").count() == 0
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") <= 2 and time.time() - began < 240


def graph_of(r, n, m):
    return sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})


def by_hand(edges, s, t, depth):
    level = {s: (s,)}
    seen = {s}
    for h in range(1, depth + 1):
        new = {}
        for a, p in level.items():
            for x, b in edges:
                if x == a and b not in seen and (b not in new or p + (b,) < new[b]):
                    new[b] = p + (b,)
        if t in new:
            return h, list(new[t])
        seen |= set(new)
        level = new
    return None


def test_two_ended_paths_equal_a_walk(spark):
    r = random.Random(8)
    edges = graph_of(r, 40, 70)
    pairs = [(r.randrange(40), r.randrange(44)) for _ in range(40)] + [(3, 3), (None, 2), (2, None)]
    df, ask = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(pairs + pairs[:3], "source long, target long")
    for depth in (1, 4, 6):
        got = {(x.source, x.target): (x.length, list(x.path)) for x in T.shortest_chains(df, ask, depth).collect()}
        want = {(s, t): by_hand(edges, s, t, depth) for s, t in pairs if None not in (s, t) and s != t}
        assert got == {k: v for k, v in want.items() if v}
    assert T.shortest_chains(df, ask.limit(0)).count() == 0


def test_two_ends_make_fewer_rows(spark, monkeypatch):
    """A source that reaches 2,000 nodes and, through them, 2,000 more; one chain leads to the target: after the first level the search goes on from its end."""
    made = []
    real = T.materialize
    monkeypatch.setattr(T, "materialize", lambda df, name: (made.append((name, (out := real(df, name)).count())), out)[1])
    edges = [("s", f"x{k}") for k in range(2000)] + [(f"x{k}", f"y{k}") for k in range(2000)] + [("s", "a"), ("a", "b"), ("b", "c"), ("c", "t")]
    found = T.shortest_chains(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("s", "t")], "source string, target string")).collect()
    assert [(x.length, x.path) for x in found] == [(4, ["s", "a", "b", "c", "t"])]
    assert [n for name, n in made if name.startswith("chain_")] == [1, 1, 2001, 1, 1, 1]


def test_a_question_at_fault_stands_alone(spark):
    asked = spark.createDataFrame([(k,) for k in range(20)], "question_id int")
    runs = []

    def run(some):
        ids = {r[0] for r in some.collect()}
        runs.append(len(ids))
        if ids & {7, 13}:
            raise OSError("the model choked")
        return some.withColumn("found", F.col("question_id") * 2)

    done, bad = H.isolated(asked, run, "vector")
    assert {r.question_id for r in done.collect()} == set(range(20)) - {7, 13} and len(runs) < 40
    assert sorted((r.question_id, r.retriever, r.error) for r in bad.collect()) == [(k, "vector", "OSError: the model choked") for k in (7, 13)]


def test_a_retriever_that_is_down_is_given_up(spark):
    asked = spark.createDataFrame([(k,) for k in range(200)], "question_id int")
    runs = []

    def run(some):
        runs.append(1)
        raise OSError("down")

    done, bad = H.isolated(asked, run, "graph")
    assert done is None and bad.count() == bad.select("question_id").distinct().count() == 200 and len(runs) <= 2 * H.FAILURES


def test_one_retriever_fails_and_the_other_answers(spark):
    from stratagraph.operators.graph import Graph
    from stratagraph.plans.engine import EDGES, NODES

    chunks = spark.createDataFrame([("r", f"f{k}.py", "function", f"n{k}", 1, 5, f"text {k}", "python", [1.0, float(k)]) for k in range(5)], "repository_id string, file_path string, entity_type string, entity_name string, start_line int, end_line int, content string, language string, embedding array<double>")
    nodes = spark.createDataFrame([("Function:a.py:go", "Function", "a.py", None, "go", "python", None, None, 3, 4, "r")], NODES)
    g = Graph(nodes, spark.createDataFrame([], EDGES))
    asked = spark.createDataFrame([(1, "r", "Explain how does `go` work")], "question_id int, repository_id string, question string")
    embed = lambda c: F.array(F.lit(1.0), F.lit(0.0))
    both = H.retrieve(asked, chunks, g, embed=embed)
    assert {r.source for r in both.ranked.collect()} == {"vector", "graph"} and both.degraded.count() == 0
    no_vector = H.retrieve(asked, chunks, g, embed=lambda c: F.raise_error(F.lit("no model")).cast("array<double>"))
    assert {(r.source, r.file_path) for r in no_vector.ranked.collect()} == {("graph", "a.py")} and [(r.question_id, r.retriever) for r in no_vector.degraded.collect()] == [(1, "vector")]
    no_graph = H.retrieve(asked, chunks, Graph(nodes.withColumn("name", F.raise_error(F.lit("gone")).cast("string")), g.edges), embed=embed)
    assert {r.source for r in no_graph.ranked.collect()} == {"vector"} and [r.retriever for r in no_graph.degraded.collect()] == ["graph"] and no_graph.facts.count() == 0
    neither = H.retrieve(asked, chunks, Graph(nodes.withColumn("name", F.raise_error(F.lit("gone")).cast("string")), g.edges), embed=lambda c: F.raise_error(F.lit("no model")).cast("array<double>"))
    assert neither.ranked.count() == 0 and neither.degraded.count() == 2
