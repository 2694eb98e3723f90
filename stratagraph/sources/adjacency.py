"""A graph's physical index (G9, S16): nodes by id, edges by source and edges by target, bucketed and sorted.

Each table is written once with its rows dealt to buckets by a hash of the lookup key and sorted by it within a bucket. A join on
that key reads the buckets as they lie: of what is looked up, only the smaller side is shuffled, and neither side of the
edges is. A traversal that asks level after level shuffles its frontier alone.

Buckets are found by file names, so an index can be opened in a later session from its folder.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratagraph.operators.graph import Graph
from stratagraph.sources.versions import Files

#: Lookup key of each table.
KEYS = {"nodes": "node_id", "out": "src", "into": "dst"}
#: Edges of a bucket that is no more than a task's work, and buckets at most.
BUCKET_ROWS, MOST = 2_000_000, 8192


@dataclass(frozen=True)
class Adjacency:
    """nodes, edges by source (out) and edges by target (into); `buckets` of each."""

    nodes: DataFrame
    out: DataFrame
    into: DataFrame
    buckets: int

    def around(self, out: bool) -> DataFrame:
        """(here, there, rel_type) of edges, lying by `here`."""
        edges, (here, there) = (self.out, ("src", "dst")) if out else (self.into, ("dst", "src"))
        return edges.select(F.col(here).alias("here"), F.col(there).alias("there"), "rel_type")


def write_index(graph: Graph, folder: str, buckets: int | None = None) -> Adjacency:
    """Write the index of a graph to a folder that is not there yet, and open it. By default a bucket holds BUCKET_ROWS edges or less, and there are as many as shuffle partitions at least."""
    spark = graph.nodes.sparkSession
    if buckets is None:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = min(MOST, max(least, -(-graph.edges.count() // BUCKET_ROWS)))
    schemas = {}
    for name, key in KEYS.items():
        df = graph.nodes if name == "nodes" else graph.edges
        schemas[name] = df.schema.jsonValue()
        made = f"stratagraph_{uuid.uuid4().hex}"
        # Dealt as the buckets are, so that each bucket is one file of one task.
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", f"{folder}/{name}").saveAsTable(made)
        spark.sql(f"DROP TABLE {made}")  # the files stay
    Files(spark, folder).write("index.json", json.dumps({"buckets": buckets, "schemas": schemas}))
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> Adjacency:
    """An index as it was written. Its tables are known to the session under names of their own."""
    told = json.loads(Files(spark, folder).text("index.json"))
    frames = {}
    for name, key in KEYS.items():
        table = f"stratagraph_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(told["schemas"][name]))
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {told['buckets']} BUCKETS LOCATION '{folder}/{name}'")
        frames[name] = spark.table(table)
    return Adjacency(frames["nodes"], frames["out"], frames["into"], told["buckets"])


def neighbours(index: Adjacency, ids: DataFrame, out: bool = True, rel_types: list[str] | None = None) -> DataFrame:
    """One hop from ids(here, ...): their rows with there and rel_type. Only ids are shuffled."""
    edges = index.around(out)
    edges = edges if rel_types is None else edges.where(F.col("rel_type").isin(rel_types))
    return ids.hint("merge").join(edges, "here")


def reach(index: Adjacency, starts: DataFrame, depth: int, out: bool = True, rel_types: list[str] | None = None) -> DataFrame:
    """(start, id, hops) of all that starts(start) reach in at most `depth` directed hops, themselves at hops 0; each level shuffles its frontier alone."""
    from stratagraph.plans.scratch import materialize

    level = materialize(starts.select("start", F.col("start").alias("id"), F.lit(0).alias("hops")).distinct(), "reach_0")
    seen = level
    for h in range(1, depth + 1):
        step = neighbours(index, level.select("start", F.col("id").alias("here")), out, rel_types).select("start", F.col("there").alias("id")).distinct()
        level = materialize(step.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("hops", F.lit(h)), f"reach_{h}")
        if level.limit(1).count() == 0:
            break
        seen = seen.unionByName(level)
    return seen
