"""The graph's merge carries no source texts, and writes in `dealt_for` take more tasks and leave the session as it was."""

from stratagraph.operators import graph as G
from stratagraph.operators.parsing import parse_repository
from stratagraph.plans import fixture, scratch


def test_no_source_texts_in_the_merge(spark):
    p = parse_repository(fixture.files(spark))
    assert "source_code" in p.entities.columns
    plan = G.build_graph(p.entities, p.imports, p.calls, p.inherits).nodes._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" in plan and not [line for line in plan.split("\n") if "max_by" in line and "source_code" in line]


def test_dealt_for(spark, monkeypatch):
    monkeypatch.setattr(scratch, "TASK_ROWS", 10)
    key = "spark.sql.shuffle.partitions"
    before = {k: spark.conf.get(k) for k in (key, "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    with scratch.dealt_for(spark, 95):
        assert spark.conf.get(key) == "10"
    with scratch.dealt_for(spark, 5):
        assert spark.conf.get(key) == before[key]
    assert {k: spark.conf.get(k) for k in before} == before
