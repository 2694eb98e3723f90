"""What a task sorts does not grow with the table."""

import __spark_entry__ as entry
from stratagraph.plans import scratch

SF = "/root/testdata/sf0.001"


def test_neighbourhood_is_dealt_out_by_rows(spark, monkeypatch):
    monkeypatch.setattr(scratch, "TASK_ROWS", 500)
    assert entry.queries()["neighbourhood"](spark, SF).rdd.getNumPartitions() > 20  # over 7,000 edges in both directions; 4 are the session's shuffle partitions
