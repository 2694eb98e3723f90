"""A graph that is read several times is written once, and is the same graph."""

from stratagraph.plans.tables import code_graph

SF = "/root/testdata/sf0.001"


def test_written_graph_is_the_same(spark):
    lazy, written = code_graph(spark, SF), code_graph(spark, SF, write=True)
    for a, b in ((lazy.nodes, written.nodes), (lazy.edges, written.edges)):
        assert all("stratagraph-" in f for f in b.inputFiles()) and b.inputFiles()
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
