"""Patterns over typed edges (Q17): paths, stars and cycles as joins, ordered by counted degrees.

A pattern is a list of (variable, relation, variable). A row of the result binds each variable to a node. Edges are counted by
relation, with the distinct nodes at each of their ends, in one pass; the joins then start at the relation with fewest edges and
always go on with the edge that makes least rows: one between two bound variables first, as it only filters, else the
one whose nodes have the fewest edges on average. A cycle is closed by a semi join on both its ends, so no row is made for what does not close.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.plans.scratch import materialize

Edge = tuple[str, str, str]


@dataclass(frozen=True)
class Counts:
    """Edges of a relation, and distinct nodes at their two ends."""

    edges: int
    sources: int
    targets: int


def counted(edges: DataFrame, relations: list[str]) -> dict[str, Counts]:
    """Counts of the relations: a row for each node and relation, then a row a relation."""
    ends = edges.where(F.col("rel_type").isin(relations)).select("rel_type", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("src").alias("id")), F.struct(F.lit(1).alias("end"), F.col("dst").alias("id")))).alias("e"))
    nodes = ends.groupBy("rel_type", "e.end", "e.id").agg(F.count("*").alias("n"))
    rows = nodes.groupBy("rel_type").agg(F.sum(F.when(F.col("end") == 0, F.col("n"))).alias("edges"), F.count_if(F.col("end") == 0).alias("s"), F.count_if(F.col("end") == 1).alias("t")).collect()
    found = {r["rel_type"]: Counts(r["edges"], r["s"], r["t"]) for r in rows}
    return {r: found.get(r, Counts(0, 0, 0)) for r in relations}


def order(pattern: list[Edge], counts: dict[str, Counts]) -> list[Edge]:
    """The pattern's edges in the order of their joins. ValueError where they do not hang together."""
    left = sorted(pattern, key=lambda e: (counts[e[1]].edges, e))
    out = [left.pop(0)]
    bound = {out[0][0], out[0][2]}
    while left:
        def growth(e: Edge) -> float:
            c = counts[e[1]]
            if e[0] in bound and e[2] in bound:
                return -1.0
            return c.edges / max(1, c.sources) if e[0] in bound else c.edges / max(1, c.targets)

        near = [e for e in left if e[0] in bound or e[2] in bound]
        if not near:
            raise ValueError("the pattern's edges do not hang together")
        best = min(near, key=lambda e: (growth(e), e))
        left.remove(best)
        out.append(best)
        bound |= {best[0], best[2]}
    return out


def match(edges: DataFrame, pattern: list[Edge]) -> DataFrame:
    """A row for each way to bind the variables so that every edge of the pattern is there: columns named by the variables, distinct rows.

    edges(src, dst, rel_type). Variables may be bound to one node; an edge from a variable to itself asks for a loop.
    """
    if not pattern:
        raise ValueError("a pattern has an edge at least")
    relations = sorted({r for _, r, _ in pattern})
    rows = materialize(edges.where(F.col("rel_type").isin(relations)).select("src", "dst", "rel_type").distinct(), "pattern_edges")
    out = None
    for a, rel, b in order(pattern, counted(rows, relations)):
        one = rows.where(F.col("rel_type") == rel)
        one = one.where("src = dst").select(F.col("src").alias(a)) if a == b else one.select(F.col("src").alias(a), F.col("dst").alias(b))
        if out is None:
            out = one
            continue
        shared = [v for v in dict.fromkeys((a, b)) if v in out.columns]
        out = out.join(one, shared, "left_semi" if len(shared) == len(one.columns) else "inner")
    return out.select(*sorted(out.columns))
