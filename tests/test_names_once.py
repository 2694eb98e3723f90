"""What a graph tells of a name is found once, whatever number of questions asks for it, and rows of one key are combined before they are sorted."""

from pyspark.sql import functions as F

from stratagraph.operators import facts as H
from stratagraph.operators import graph as G
from stratagraph.operators.questions import analyse
from stratagraph.plans import tables
from stratagraph.plans.scratch import materialize

SF = "/root/testdata/sf0.001"


def test_many_questions_for_one_name(spark, monkeypatch):
    g = tables.code_graph(spark, SF, write=True)
    written = {}

    def noted(df, name):
        out = materialize(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(H, "materialize", noted)
    kinds = ["Explain how does `f7` work", "What calls `f7`?", "What does `f7` call?", "Which classes inherit from `C5`?", "What happens when f7() fails in the pipeline?"]

    def told(times):
        asked = spark.createDataFrame([(k, "ASIA", kinds[k % len(kinds)]) for k in range(times * len(kinds))], "question_id long, repository_id string, question string")
        rows = H.graph_context(analyse(asked), g).drop("question_id").withColumn("k", F.lit(0)).collect()
        return sorted(map(repr, rows)), dict(written)

    one, few = told(1)
    many, more = told(20)
    assert one and many == sorted(one * 20)
    assert more == few and few["named_links"]


def test_calls_only_where_asked(spark, monkeypatch):
    g = tables.code_graph(spark, SF, write=True)
    links = []
    monkeypatch.setattr(H, "materialize", lambda df, name: links.append(materialize(df, name)) or links[-1] if name == "named_links" else materialize(df, name))
    asked = spark.createDataFrame([(1, "ASIA", "Explain how does `f7` work")], "question_id long, repository_id string, question string")
    assert H.graph_context(analyse(asked), g).count() > 0
    assert links[0].count() == 0
    H.graph_context(analyse(asked.withColumn("question", F.lit("What calls `f7`?"))), g)
    assert links[1].count() > 0


def test_expansion_of_many_questions(spark, monkeypatch):
    g = tables.code_graph(spark, SF, write=True)
    written = {}

    def noted(df, name):
        out = materialize(df, name)
        written[name] = written.get(name, []) + [out.count()]
        return out

    monkeypatch.setattr(H, "materialize", noted)
    hits = spark.range(40).selectExpr("id as question_id", "'ASIA' as repository_id", "1 as position", "'function' as entity_type", "'f7' as entity_name")
    one, many = (sorted(map(repr, H.expansion(h, g).drop("question_id").collect())) for h in (hits.limit(1), hits))
    assert one and many == sorted(one * 40)
    assert len(set(written["seeds"])) == 1


def test_newest_is_last(spark):
    rows = [(k % 3 or None, "n" if k % 2 else None, k % 50, f"s{k % 50}") for k in range(400)] + [(9, "x", None, "s"), (1, "n", None, "t")]
    df = spark.createDataFrame(rows, "a int, b string, seq int, v string")
    last, newest = G._last(df, ["a", "b"]), G._newest(df, ["a", "b"])
    assert sorted(map(repr, last.collect())) == sorted(map(repr, newest.collect()))
    assert "LeftSemi" in newest._jdf.queryExecution().optimizedPlan().toString()


def test_orders_meet_customers_once(spark, monkeypatch):
    given = []
    monkeypatch.setattr(G, "build_graph", lambda *a: given.extend(a))
    tables.code_graph(spark, SF, write=True)
    assert not [f for df in given[1:3] for f in df.inputFiles() if "/orders" in f]


def test_many_customers_are_not_broadcast(spark, monkeypatch):
    want = sorted(map(repr, tables.code_rows(spark, SF)[3].collect()))
    plans = []
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(tables, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or materialize(df, name))
    assert sorted(map(repr, tables.code_rows(spark, SF, write=True)[3].collect())) == want
    assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]
