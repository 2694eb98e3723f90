"""The rows of a small file of keys are the work of several tasks."""

from stratagraph.plans import templates

SF = "/root/testdata/sf0.001"


def test_keys_are_dealt_out(spark):
    each = templates.each(spark, SF, "supplier", "s_suppkey", [("a{n}",), ("b",)], "x string")
    assert each.rdd.getNumPartitions() >= 2
    dealt = templates.dealt(spark, SF, "supplier", "s_suppkey", [("a{n}",), ("b",)], "x string")
    assert dealt.rdd.getNumPartitions() >= 2
    assert each.count() == 2 * dealt.count() and dealt.select("n").distinct().count() == dealt.count()
