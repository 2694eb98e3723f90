"""Bounded traversals: k-hop balls (Q11) and shortest dependency chains (Q14).

A level is written before the next one reads it, so that a plan holds one step, and a traversal ends with the
first empty frontier. A level is one join of the frontier with the links, which are written once too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.plans.scratch import materialize

MAX_BALL_DEPTH = 3
MAX_CHAIN = 6


def _empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def ball(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, id, hops) within `depth` (1..3) undirected hops; the start itself has hops 0, also when it has no edge.

    A frontier keeps only nodes that are new to their start.
    """
    depth = max(1, min(MAX_BALL_DEPTH, depth))
    links = materialize(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    reached = frontier = materialize(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops")).distinct(), "ball_0")
    for h in range(1, depth + 1):
        step = frontier.select("start", F.col("id").alias("src")).join(links, "src").select("start", F.col("dst").alias("id")).distinct()
        frontier = materialize(step.join(reached.select("start", "id"), ["start", "id"], "left_anti").withColumn("hops", F.lit(h)), f"ball_{h}")
        if _empty(frontier):
            break
        reached = reached.unionByName(frontier)
    return reached


def ball_network(edges: DataFrame, starts: DataFrame, depth: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Q11: (nodes with hops and focus flag; induced edges, at most `limit` a start by id order, with truncated)."""
    nodes = ball(edges, starts, depth)
    ends = nodes.select("start", "id")
    inside = edges.select("src", "dst").distinct().join(ends.withColumnRenamed("id", "src"), "src").join(ends.withColumnRenamed("id", "dst"), ["start", "dst"]).select("start", "src", "dst")
    per = Window.partitionBy("start")
    cut = inside.withColumn("__n", F.count("*").over(per)).withColumn("__k", F.row_number().over(per.orderBy("src", "dst"))).where(F.col("__k") <= limit)
    return nodes.withColumn("focus", F.col("hops") == 0), cut.select("start", "src", "dst", (F.col("__n") > limit).alias("truncated"))


def chains_from(edges: DataFrame, sources: DataFrame, depth: int = MAX_CHAIN) -> DataFrame:
    """(source, target, length, path) of a shortest directed chain of at most `depth` edges to every node that each of sources(source) reaches.

    Among equally short chains the lexicographically smallest path. Each level keeps one path for each (source, node),
    so a level has at most sources x nodes rows, whatever the number of paths.
    """
    links = materialize(edges.select(F.col("src").alias("node"), "dst").distinct(), "links")
    start = sources.select("source").distinct().select("source", F.col("source").alias("node"), F.array("source").alias("path"))
    frontier = materialize(start, "chains_0")
    seen, found = frontier.select("source", "node"), None
    for h in range(1, depth + 1):
        step = frontier.join(links, "node").select("source", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        level = step.groupBy("source", "node").agg(F.min("path").alias("path")).join(seen, ["source", "node"], "left_anti")
        frontier = materialize(level, f"chains_{h}")
        if found is not None and _empty(frontier):
            break
        seen = seen.unionByName(frontier.select("source", "node"))
        hit = frontier.select("source", F.col("node").alias("target"), F.lit(h).alias("length"), "path")
        found = hit if found is None else found.unionByName(hit)
    return found


def shortest_chains(edges: DataFrame, pairs: DataFrame, depth: int = MAX_CHAIN) -> DataFrame:
    """Q14: (source, target, length, path) of a shortest directed chain of at most `depth` edges for each of pairs(source, target); no row where there is none.

    Both ends are searched, a level at a time on the side whose frontier has fewer rows, until they meet: what far ends reach beyond
    the middle is never made. Among equally short chains the smallest path: each side keeps the smallest path of each node,
    and all shortest chains of a pair cross the level where its sides meet. A pair that has met is searched no more. For all targets of a source, use `chains_from`.
    """
    ends = ["source", "target"]
    links = materialize(edges.select("src", "dst").distinct(), "links")
    asked = pairs.select(*ends).distinct().where("source is not null and target is not null and source <> target")
    sides = [materialize(asked.select(*ends, F.col(c).alias("node"), F.array(c).alias("path")), f"chain_{c}") for c in ends]
    seen = [s.select(*ends, "node") for s in sides]
    rows, found, met = [s.count() for s in sides], None, None
    for length in range(1, depth + 1):
        if not min(rows):
            break
        k = 0 if rows[0] <= rows[1] else 1
        here, there = ("src", "dst") if k == 0 else ("dst", "src")
        step = sides[k].join(links.select(F.col(here).alias("node"), F.col(there).alias("next")), "node")
        path = F.concat("path", F.array("next")) if k == 0 else F.concat(F.array("next"), "path")
        level = step.select(*ends, F.col("next").alias("node"), path.alias("path")).groupBy(*ends, "node").agg(F.min("path").alias("path"))
        sides[k] = materialize(level.join(seen[k], [*ends, "node"], "left_anti"), f"chain_{length}")
        seen[k] = seen[k].unionByName(sides[k].select(*ends, "node"))
        left, right = (sides[j].withColumnRenamed("path", f"p{j}") for j in (0, 1))
        meeting = left.join(right, [*ends, "node"]).select(*ends, F.concat("p0", F.slice("p1", 2, depth + 1)).alias("path"))
        hit = materialize(meeting.groupBy(*ends).agg(F.min("path").alias("path")).withColumn("length", F.lit(length)), f"met_{length}")
        if not _empty(hit):
            found = hit if found is None else found.unionByName(hit)
            met = hit.select(*ends) if met is None else met.unionByName(hit.select(*ends))
            sides = [s.join(met, ends, "left_anti") for s in sides]
        rows = [s.count() for s in sides]
    if found is None:
        found = sides[0].limit(0).select(*ends, "path", F.lit(0).alias("length"))
    return found.select(*ends, "length", "path")
