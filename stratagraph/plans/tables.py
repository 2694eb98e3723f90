"""Driver tables, and graphs and lists derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratagraph.plans.scratch import BROADCAST_ROWS, materialize, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dep(spark: SparkSession, sf_dir: str, by: str = "src") -> DataFrame:
    """Part to next part among an order's large lines: (src, dst), distinct, without loops, dealt out by one end."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.count()
    lines = spread(lines.where("l_quantity >= 40").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), rows, "l_orderkey")
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return spread(lines.select(F.col("l_partkey").alias("src"), following.alias("dst")).where("dst is not null and src <> dst"), rows, by).distinct()


DEP_SQL = """dep AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst
FROM lineitem WHERE l_quantity >= 40) WHERE dst IS NOT NULL AND src <> dst)"""


def nodes_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of six tables as labelled nodes (node_type, node_id, name)."""
    parts = [("Region", "region", "r_regionkey", "r_name"), ("Nation", "nation", "n_nationkey", "n_name"), ("Customer", "customer", "c_custkey", "c_name"), ("Supplier", "supplier", "s_suppkey", "s_name"), ("Part", "part", "p_partkey", "p_name"), ("Order", "orders", "o_orderkey", "o_orderstatus")]
    out = None
    for kind, name, key, label in parts:
        df = table(spark, sf_dir, name).select(F.lit(kind).alias("node_type"), F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("node_id"), F.col(label).alias("name"))
        out = df if out is None else out.unionByName(df)
    return out


NODES_FK_SQL = "nodes_fk AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS node_type, '{k}:' || CAST({key} AS VARCHAR) AS node_id, {label} AS name FROM {t}"
    for k, t, key, label in (("Region", "region", "r_regionkey", "r_name"), ("Nation", "nation", "n_nationkey", "n_name"), ("Customer", "customer", "c_custkey", "c_name"), ("Supplier", "supplier", "s_suppkey", "s_name"), ("Part", "part", "p_partkey", "p_name"), ("Order", "orders", "o_orderkey", "o_orderstatus"))
) + ")"


def edges_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as typed edges (rel_type, src, dst)."""
    def edge(name: str, rel: str, a: str, ak: str, b: str, bk: str) -> DataFrame:
        ident = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
        return table(spark, sf_dir, name).select(F.lit(rel).alias("rel_type"), ident(a, ak).alias("src"), ident(b, bk).alias("dst"))

    return (
        edge("nation", "CONTAINS", "Region", "n_regionkey", "Nation", "n_nationkey")
        .unionByName(edge("customer", "CONTAINS", "Nation", "c_nationkey", "Customer", "c_custkey"))
        .unionByName(edge("supplier", "CONTAINS", "Nation", "s_nationkey", "Supplier", "s_suppkey"))
        .unionByName(edge("orders", "PLACES", "Customer", "o_custkey", "Order", "o_orderkey"))
        .unionByName(spread(edge("lineitem", "SUPPLIES", "Supplier", "l_suppkey", "Part", "l_partkey"), table(spark, sf_dir, "lineitem").count(), "dst").distinct())
    )


EDGES_FK_SQL = """edges_fk AS (SELECT 'CONTAINS' AS rel_type, 'Region:' || n_regionkey AS src, 'Nation:' || n_nationkey AS dst FROM nation
UNION ALL SELECT 'CONTAINS', 'Nation:' || c_nationkey, 'Customer:' || c_custkey FROM customer
UNION ALL SELECT 'CONTAINS', 'Nation:' || s_nationkey, 'Supplier:' || s_suppkey FROM supplier
UNION ALL SELECT 'PLACES', 'Customer:' || o_custkey, 'Order:' || o_orderkey FROM orders
UNION ALL SELECT DISTINCT 'SUPPLIES', 'Supplier:' || l_suppkey, 'Part:' || l_partkey FROM lineitem)"""


def code_rows(spark: SparkSession, sf_dir: str, write: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(files, entities, imports, calls, inherits) as parsers and resolution give them, made of the tables.

    Regions are repositories and nations their files; suppliers define classes, customers functions and orders methods,
    with names that repeat within a file. Orders are imports and calls too, suppliers name base classes; targets may be
    null, in another repository, or not defined. write: orders meet their customers once, as numbers, and are read from there.
    """
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    place = nation.select(F.col("n_nationkey").alias("k"), F.col("r_name").alias("repository_id"), F.concat(F.lit("src/"), F.lower("n_name"), F.lit(".py")).alias("file_path"))
    files = place.select("repository_id", "file_path", F.lit("python").alias("language"))
    path = place.select(F.col("k").alias("tk"), F.col("file_path").alias("target"))
    cls = lambda c: F.concat(F.lit("C"), (c % 37).cast("string"))
    none = F.lit(None).cast("string")

    def entity(df: DataFrame, kind: str, name, parent, key: str):
        line = (F.col(key) % 500).cast("int")
        return df.select(
            "repository_id", "file_path", F.lit("python").alias("language"), F.lit(kind).alias("entity_type"), name.alias("entity_name"), line.alias("start_line"), (line + 9).alias("end_line"),
            F.concat(F.lit("sig "), F.col(key).cast("string")).alias("signature"), none.alias("docstring"), parent.alias("parent_name"), F.col(key).cast("long").alias("seq"),
        )

    suppliers = table(spark, sf_dir, "supplier").join(F.broadcast(place), F.col("s_nationkey") == F.col("k"))
    customers = table(spark, sf_dir, "customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("k"))
    orders = table(spark, sf_dir, "orders")
    if write:
        nations = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
        orders = orders.select("o_orderkey", "o_custkey")
        if nations.count() <= BROADCAST_ROWS:
            nations = F.broadcast(nations)
        else:  # hinted, as files of numbers are small enough for Spark to broadcast millions of rows
            rows = orders.count()
            orders, nations = spread(orders, rows, "o_custkey"), spread(nations, rows, "c_custkey").hint("merge")
        orders = materialize(orders.join(nations, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey"), "placed").join(F.broadcast(place), "k")
    else:
        orders = orders.join(customers.select("c_custkey", "repository_id", "file_path"), F.col("o_custkey") == F.col("c_custkey"))
    entities = (
        entity(suppliers, "class", cls(F.col("s_suppkey")), none, "s_suppkey")
        .unionByName(entity(customers, "function", F.concat(F.lit("f"), (F.col("c_custkey") % 101).cast("string")), none, "c_custkey"))
        .unionByName(entity(orders, "method", F.concat(F.lit("m"), (F.col("o_orderkey") % 13).cast("string")), F.when(F.col("o_orderkey") % 11 > 0, cls(F.col("o_custkey"))), "o_orderkey"))
    )
    aimed = orders.withColumn("tk", (F.col("o_orderkey") % 29).cast("int")).join(F.broadcast(path), "tk", "left")
    line = (F.col("o_orderkey") % 500).cast("int").alias("line")
    seq = F.col("o_orderkey").cast("long").alias("seq")
    imports = aimed.select("repository_id", seq, F.col("file_path").alias("source_file"), F.col("target").alias("resolved_file"), F.concat(F.lit("mod"), (F.col("o_orderkey") % 5).cast("string")).alias("module"), line)
    callee = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("m"), (F.col("o_orderkey") % 17).cast("string"))).otherwise(F.concat(F.lit("f"), (F.col("o_custkey") % 107).cast("string")))
    caller = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("m"), (F.col("o_custkey") % 13).cast("string"))).otherwise(F.concat(F.lit("f"), (F.col("o_custkey") % 101).cast("string")))
    calls = aimed.select("repository_id", seq, F.col("file_path").alias("caller_file"), caller.alias("caller_name"), F.when(F.col("o_orderkey") % 4 == 0, F.col("file_path")).otherwise(F.col("target")).alias("callee_file"), callee.alias("callee_name"), line)
    base = suppliers.withColumn("tk", (F.col("s_suppkey") % 27).cast("int")).join(F.broadcast(path), "tk", "left")
    inherits = base.select("repository_id", F.col("s_suppkey").cast("long").alias("seq"), F.col("file_path").alias("child_file"), cls(F.col("s_suppkey")).alias("child_class"), F.when(F.col("s_suppkey") % 3 == 0, F.col("file_path")).otherwise(F.col("target")).alias("parent_file"), cls(F.col("s_suppkey") * 7).alias("parent_class"))
    return files, entities, imports, calls, inherits


def code_graph(spark: SparkSession, sf_dir: str, write: bool = False):
    """The property graph of `code_rows`; write: for several readers."""
    from stratagraph.operators.graph import build_graph

    files, entities, imports, calls, inherits = code_rows(spark, sf_dir, write)
    return build_graph(entities, imports, calls, inherits, files, write)


CODE_SQL = """place AS (SELECT n_nationkey AS k, r_name AS rid, 'src/' || lower(n_name) || '.py' AS path FROM nation JOIN region ON n_regionkey = r_regionkey),
cu AS (SELECT c_custkey, rid, path FROM customer JOIN place ON c_nationkey = k), su AS (SELECT s_suppkey, rid, path FROM supplier JOIN place ON s_nationkey = k),
od AS (SELECT o_orderkey AS o, o_custkey AS c, cu.rid, cu.path, t.path AS target FROM orders JOIN cu ON c_custkey = o_custkey LEFT JOIN place t ON t.k = o_orderkey % 29),
ent AS (SELECT rid, path, 'Class' AS kind, 'C' || (s_suppkey % 37) AS name, CAST(NULL AS VARCHAR) AS parent, s_suppkey AS key FROM su
UNION ALL SELECT rid, path, 'Function', 'f' || (c_custkey % 101), NULL, c_custkey FROM cu
UNION ALL SELECT rid, path, 'Method', 'm' || (o % 13), 'C' || (c % 37), o FROM od WHERE o % 11 > 0),
last_ent AS (SELECT rid, path, kind, name, parent, max(key) AS key FROM ent GROUP BY ALL),
code_nodes AS (SELECT DISTINCT rid AS repository_id, 'Repository:' || rid AS node_id, 'Repository' AS node_type, CAST(NULL AS VARCHAR) AS file_path, CAST(NULL AS VARCHAR) AS class_name, rid AS name, CAST(NULL AS VARCHAR) AS language, CAST(NULL AS VARCHAR) AS signature, CAST(NULL AS VARCHAR) AS docstring, CAST(NULL AS INT) AS start_line, CAST(NULL AS INT) AS end_line FROM place
UNION ALL SELECT rid, 'File:' || path, 'File', path, NULL, substring(path, 5), 'python', NULL, NULL, NULL, NULL FROM place
UNION ALL SELECT rid, concat_ws(':', kind, path, parent, name), kind, path, parent, name, 'python', 'sig ' || key, NULL, CAST(key % 500 AS INT), CAST(key % 500 + 9 AS INT) FROM last_ent),
callables AS (SELECT repository_id AS rid, file_path AS path, name, arg_min(node_id, (CASE node_type WHEN 'Function' THEN 0 ELSE 1 END, start_line, node_id)) AS id, min(node_type) AS t FROM code_nodes WHERE node_type IN ('Function', 'Method') GROUP BY 1, 2, 3),
im AS (SELECT rid, path, target, max(o) AS o FROM od WHERE EXISTS (SELECT 1 FROM place p WHERE p.rid = od.rid AND p.path = od.target) GROUP BY ALL),
ca AS (SELECT od.rid, a.id AS src, b.id AS dst, CASE WHEN a.t = 'Method' AND b.t = 'Method' THEN 'METHOD_CALLS_METHOD' ELSE 'FUNCTION_CALLS_FUNCTION' END AS rel, max(o) AS o FROM od
JOIN callables a ON a.rid = od.rid AND a.path = od.path AND a.name = CASE WHEN o % 3 = 0 THEN 'm' || (c % 13) ELSE 'f' || (c % 101) END
JOIN callables b ON b.rid = od.rid AND b.path = CASE WHEN o % 4 = 0 THEN od.path ELSE target END AND b.name = CASE WHEN o % 2 = 0 THEN 'm' || (o % 17) ELSE 'f' || (c % 107) END GROUP BY ALL),
inh AS (SELECT DISTINCT su.rid, su.path, 'C' || (s_suppkey % 37) AS child, CASE WHEN s_suppkey % 3 = 0 THEN su.path ELSE t.path END AS base_path, 'C' || (s_suppkey * 7 % 37) AS base FROM su LEFT JOIN place t ON t.k = s_suppkey % 27),
code_edges AS (SELECT rid AS repository_id, 'REPOSITORY_CONTAINS_FILE' AS rel_type, 'Repository:' || rid AS src, 'File:' || path AS dst, CAST(NULL AS VARCHAR) AS module, CAST(NULL AS INT) AS line FROM place
UNION ALL SELECT rid, 'FILE_DEFINES_' || upper(kind), 'File:' || path, concat_ws(':', kind, path, parent, name), NULL, NULL FROM last_ent
UNION ALL SELECT m.rid, 'CLASS_CONTAINS_METHOD', 'Class:' || m.path || ':' || m.parent, concat_ws(':', m.kind, m.path, m.parent, m.name), NULL, NULL FROM last_ent m JOIN last_ent c ON c.kind = 'Class' AND c.rid = m.rid AND c.path = m.path AND c.name = m.parent WHERE m.kind = 'Method'
UNION ALL SELECT rid, 'FILE_IMPORTS_FILE', 'File:' || path, 'File:' || target, 'mod' || (o % 5), CAST(o % 500 AS INT) FROM im
UNION ALL SELECT rid, rel, src, dst, NULL, CAST(o % 500 AS INT) FROM ca
UNION ALL SELECT i.rid, 'CLASS_INHERITS_CLASS', 'Class:' || i.path || ':' || child, 'Class:' || base_path || ':' || base, NULL, NULL FROM inh i JOIN last_ent a ON a.kind = 'Class' AND a.rid = i.rid AND a.path = i.path AND a.name = child JOIN last_ent b ON b.kind = 'Class' AND b.rid = i.rid AND b.path = base_path AND b.name = base)"""
