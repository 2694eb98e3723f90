"""Queries over vectors and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.operators import graph as G
from stratagraph.operators import inverted_file as I
from stratagraph.operators import patterns as M
from stratagraph.operators import traverse as T
from stratagraph.operators import vector_search as V
from stratagraph.plans.registry import query
from stratagraph.plans.scratch import shared_dir
from stratagraph.plans.tables import CODE_SQL, DEP_SQL, EDGES_FK_SQL, NODES_FK_SQL, code_graph, dep, edges_fk, nodes_fk, table
from stratagraph.sources import adjacency as A

_SIM = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and every hundredth as a query."""
    vectors = table(spark, d, "embeddings")
    return vectors, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round({_SIM}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, CAST(rank AS INT) AS rank, score, CASE WHEN rank <= 3 THEN 0 ELSE 3 END AS tier, 'semantic match, rank ' || rank AS reason FROM r WHERE rank <= 5""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors, queries = _vectors(spark, d)
    return V.with_tier(V.top_k(vectors, queries, 5, "vec_id", exclude_self=True))


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round({_SIM}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.label IN (1, 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, CAST(rank AS INT) AS rank, score FROM r WHERE rank <= 8""")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    vectors, queries = _vectors(spark, d)
    return V.top_k(vectors, queries, 8, "vec_id", where=F.col("label").isin(1, 3))


@query()
def vector_inverted_file(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every hundredth vector, by an index whose probes are set for a recall of 0.95."""
    vectors, queries = _vectors(spark, d)
    index = I.build(vectors, id_col="vec_id")
    return I.search(index, queries, 10, I.probes_for(index, vectors, id_col="vec_id"), "vec_id", exclude_self=True)


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round({_SIM}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, CAST(rank AS INT) AS rank, score FROM r WHERE rank <= 10""")
def vector_inverted_file_exact(spark: SparkSession, d: str) -> DataFrame:
    vectors, queries = _vectors(spark, d)
    index = I.build(vectors, id_col="vec_id")
    return I.search_exact(index, queries, 10, max(1, len(index.centroids) // 4), "vec_id", exclude_self=True)


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def vector_count(spark: SparkSession, d: str) -> DataFrame:
    return V.count_vectors(table(spark, d, "embeddings"), "label")


@query(f"WITH {CODE_SQL} SELECT * FROM code_nodes")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return code_graph(spark, d).nodes


@query(f"WITH {CODE_SQL} SELECT * FROM code_edges")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return code_graph(spark, d).edges


@query(f"WITH {CODE_SQL} SELECT repository_id, file_path, language FROM code_nodes WHERE node_type = 'File'")
def graph_files(spark: SparkSession, d: str) -> DataFrame:
    return G.files_of(code_graph(spark, d).nodes)


@query(f"""WITH {CODE_SQL}, c AS (SELECT * FROM code_nodes WHERE node_type IN ('Function', 'Method'))
SELECT repository_id, file_path, name, arg_min(node_id, (CASE node_type WHEN 'Function' THEN 0 ELSE 1 END, start_line, node_id)) AS node_id, min(node_type) AS node_type FROM c GROUP BY 1, 2, 3""")
def callable_index(spark: SparkSession, d: str) -> DataFrame:
    return G.callable_index(code_graph(spark, d).nodes)


@query(f"""WITH {NODES_FK_SQL}, {EDGES_FK_SQL}
SELECT 'node' AS kind, node_type AS type, count(*) AS n FROM nodes_fk GROUP BY GROUPING SETS ((node_type), ())
UNION ALL SELECT 'edge', rel_type, count(*) FROM edges_fk GROUP BY GROUPING SETS ((rel_type), ())""")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.statistics(nodes_fk(spark, d), edges_fk(spark, d))


@query("""WITH c AS (SELECT c_nationkey AS k, string_agg(DISTINCT c_name, ', ' ORDER BY c_name) AS classes FROM customer GROUP BY 1),
s AS (SELECT s_nationkey AS k, string_agg(DISTINCT s_name, ', ' ORDER BY s_name) AS functions FROM supplier GROUP BY 1)
SELECT n_nationkey AS nation, n_name, coalesce(classes, '') AS classes, coalesce(functions, '') AS functions FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey""")
def graph_overview(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    names = lambda t, k, n: table(spark, d, t).select(F.col(k).alias("nation"), F.col(n).alias("name"))
    return G.overview(nations, names("customer", "c_nationkey", "c_name"), names("supplier", "s_nationkey", "s_name"), "nation")


@query(f"""WITH {CODE_SQL} SELECT repository_id, file_path, coalesce(string_agg(name, ',' ORDER BY start_line, name) FILTER (node_type = 'Class'), '') AS classes,
coalesce(string_agg(name, ',' ORDER BY start_line, name) FILTER (node_type = 'Function'), '') AS functions, coalesce(string_agg(class_name || '.' || name, ',' ORDER BY start_line, name, class_name) FILTER (node_type = 'Method'), '') AS methods
FROM code_nodes WHERE file_path IS NOT NULL GROUP BY 1, 2 HAVING count(*) FILTER (node_type = 'File') > 0""")
def container_contents(spark: SparkSession, d: str) -> DataFrame:
    names = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ",")
    methods = F.array_join(F.transform("methods", lambda x: F.concat_ws(".", x["class_name"], x["name"])), ",")
    return G.contents(code_graph(spark, d).nodes).select("repository_id", "file_path", names("classes").alias("classes"), names("functions").alias("functions"), methods.alias("methods"))


def _side(rel: str, here: str, there: str) -> str:
    return f"""(SELECT string_agg(DISTINCT n.name || '@' || n.file_path, ',' ORDER BY n.name || '@' || n.file_path) FROM code_edges e JOIN code_nodes n ON n.repository_id = e.repository_id AND n.node_id = e.{there}
WHERE e.rel_type = '{rel}' AND e.repository_id = c.repository_id AND e.{here} = c.node_id)"""


@query(f"""WITH {CODE_SQL} SELECT repository_id, node_id, file_path, name, start_line, end_line, {_side("CLASS_CONTAINS_METHOD", "src", "dst")} AS methods, {_side("CLASS_INHERITS_CLASS", "src", "dst")} AS bases, {_side("CLASS_INHERITS_CLASS", "dst", "src")} AS subclasses
FROM code_nodes c WHERE node_type = 'Class'""")
def class_info(spark: SparkSession, d: str) -> DataFrame:
    g = code_graph(spark, d)
    text = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: F.concat_ws("@", x["name"], x["file_path"]))), ",").alias(c)
    return G.class_info(g.nodes, g.edges).select("repository_id", "node_id", "file_path", "name", "start_line", "end_line", *[text(c) for c in ("methods", "bases", "subclasses")])


def _parts(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias(name))


@query(f"WITH {DEP_SQL} SELECT DISTINCT dst AS target, src AS id FROM dep JOIN part ON p_partkey = dst")
def callers(spark: SparkSession, d: str) -> DataFrame:
    return G.sources_of(dep(spark, d, "dst"), _parts(spark, d, "target"))


@query(f"WITH {DEP_SQL} SELECT DISTINCT src AS source, dst AS id FROM dep JOIN part ON p_partkey = src")
def callees(spark: SparkSession, d: str) -> DataFrame:
    return G.targets_of(dep(spark, d), _parts(spark, d, "source"))


@query(f"WITH {EDGES_FK_SQL} SELECT DISTINCT dst AS target, src AS id FROM edges_fk WHERE rel_type = 'SUPPLIES'")
def importers(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "part").select(F.concat(F.lit("Part:"), F.col("p_partkey").cast("string")).alias("target"))
    return G.sources_of(edges_fk(spark, d).where("rel_type = 'SUPPLIES'"), wanted)


@query(f"WITH {EDGES_FK_SQL} SELECT DISTINCT src AS source, dst AS id FROM edges_fk WHERE rel_type = 'SUPPLIES'")
def imported_files(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "supplier").select(F.concat(F.lit("Supplier:"), F.col("s_suppkey").cast("string")).alias("source"))
    return G.targets_of(edges_fk(spark, d).where("rel_type = 'SUPPLIES'"), wanted)


@query(f"WITH {DEP_SQL} SELECT coalesce(o.id, i.id) AS id, coalesce(n, 0) AS out_degree, coalesce(m, 0) AS in_degree FROM (SELECT src AS id, count(*) AS n FROM dep GROUP BY 1) o FULL JOIN (SELECT dst AS id, count(*) AS m FROM dep GROUP BY 1) i ON o.id = i.id")
def degree_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(dep(spark, d))


@query(f"WITH {DEP_SQL} SELECT dst AS id, count(DISTINCT src) AS in_degree FROM dep GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def central_files(spark: SparkSession, d: str) -> DataFrame:
    return G.central(dep(spark, d), 20)


@query(f"WITH {DEP_SQL} SELECT src AS id, count(*) AS imports FROM dep WHERE NOT EXISTS (SELECT 1 FROM dep x WHERE x.dst = dep.src) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def entry_points(spark: SparkSession, d: str) -> DataFrame:
    return G.entry_points(dep(spark, d), 20)


_NETWORK = f"""{DEP_SQL}, deg AS (SELECT coalesce(o.id, i.id) AS id, coalesce(n, 0) AS out_degree, coalesce(m, 0) AS in_degree FROM (SELECT src AS id, count(*) AS n FROM dep GROUP BY 1) o
FULL JOIN (SELECT dst AS id, count(*) AS m FROM dep GROUP BY 1) i ON o.id = i.id), top AS (SELECT * FROM deg ORDER BY out_degree + in_degree DESC, id LIMIT 30)"""


@query(f"""WITH {_NETWORK} SELECT top.id, in_degree, out_degree, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey = top.id) AS definitions,
(SELECT count(*) FROM deg) AS total_nodes, (SELECT count(*) FROM deg) > 30 AS truncated FROM top""")
def file_network(spark: SparkSession, d: str) -> DataFrame:
    definitions = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("definition"))
    return G.network(dep(spark, d), definitions, 30)[0]


@query(f"WITH {_NETWORK} SELECT src, dst FROM dep WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top)")
def file_network_edges(spark: SparkSession, d: str) -> DataFrame:
    definitions = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("definition"))
    return G.network(dep(spark, d), definitions, 30)[1]


@query(f"""WITH {NODES_FK_SQL}, w AS (SELECT unnest(['NATION_3', 'NATION_7', 'F', 'ASIA', 'nothing']) AS name), r AS (SELECT n.*, row_number() OVER (PARTITION BY n.name ORDER BY list_position(['Region', 'Nation', 'Order'], node_type), node_id) AS position
FROM nodes_fk n JOIN w ON w.name = n.name WHERE node_type IN ('Region', 'Nation', 'Order')) SELECT name, node_type, node_id, CAST(position AS INT) AS position FROM r WHERE position <= 5""")
def find_entities(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("NATION_3",), ("NATION_7",), ("F",), ("ASIA",), ("nothing",)], "name string")
    return G.find_entities(nodes_fk(spark, d), names, 5, ("Region", "Nation", "Order")).select("name", "node_type", "node_id", "position")


@query(f"""WITH {NODES_FK_SQL}, {EDGES_FK_SQL}, b AS (SELECT src AS seed, dst AS id, rel_type, 'out' AS direction FROM edges_fk UNION SELECT dst, src, rel_type, 'in' FROM edges_fk),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY direction, rel_type, id) AS position FROM b WHERE seed IN (SELECT node_id FROM nodes_fk WHERE node_type IN ('Nation', 'Part', 'Supplier'))) SELECT seed, id, rel_type, direction, CAST(position AS INT) AS position FROM r WHERE position <= 8""")
def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    seeds = nodes_fk(spark, d).where("node_type in ('Nation', 'Part', 'Supplier')").select(F.col("node_id").alias("seed"))
    rows = sum(table(spark, d, name).count() for name in ("nation", "customer", "supplier", "orders", "lineitem"))
    return G.neighbourhood(edges_fk(spark, d), seeds, 8, rows)


@query(f"""WITH RECURSIVE {DEP_SQL}, u AS (SELECT src, dst FROM dep UNION SELECT dst, src FROM dep), w(start, id, hops) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey % 100 = 0
UNION SELECT w.start, u.dst, w.hops + 1 FROM w JOIN u ON u.src = w.id WHERE w.hops < 3) SELECT CAST(start AS BIGINT) AS start, CAST(id AS BIGINT) AS id, CAST(min(hops) AS INT) AS hops, min(hops) = 0 AS focus FROM w GROUP BY 1, 2""")
def k_hop(spark: SparkSession, d: str) -> DataFrame:
    starts = table(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").cast("long").alias("id"))
    return T.ball_network(dep(spark, d), starts, 3, 1000)[0]


@query(f"""WITH RECURSIVE {DEP_SQL}, u AS (SELECT src, dst FROM dep UNION SELECT dst, src FROM dep), w(start, id, hops) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey % 100 = 0
UNION SELECT w.start, u.dst, w.hops + 1 FROM w JOIN u ON u.src = w.id WHERE w.hops < 2), b AS (SELECT DISTINCT start, id FROM w),
i AS (SELECT b.start, src, dst, row_number() OVER (PARTITION BY b.start ORDER BY src, dst) AS k, count(*) OVER (PARTITION BY b.start) AS n FROM dep JOIN b ON b.id = src JOIN b c ON c.id = dst AND c.start = b.start)
SELECT CAST(start AS BIGINT) AS start, src, dst, n > 10 AS truncated FROM i WHERE k <= 10""")
def k_hop_edges(spark: SparkSession, d: str) -> DataFrame:
    starts = table(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").cast("long").alias("id"))
    return T.ball_network(dep(spark, d), starts, 2, 10)[1]


def _levels(depth: int) -> str:
    """SQL of shortest chains, a level a table: l0 are the sources, each next one the nodes that no earlier level has."""
    out = ["l0 AS (SELECT CAST(p_partkey AS BIGINT) AS source, CAST(p_partkey AS BIGINT) AS node, [CAST(p_partkey AS BIGINT)] AS path FROM part WHERE p_partkey % 100 = 0)"]
    for h in range(1, depth + 1):
        before = " AND ".join(f"NOT EXISTS (SELECT 1 FROM l{k} WHERE l{k}.source = f.source AND l{k}.node = dep.dst)" for k in range(h))
        out.append(f"l{h} AS MATERIALIZED (SELECT f.source, CAST(dep.dst AS BIGINT) AS node, min(list_append(f.path, CAST(dep.dst AS BIGINT))) AS path FROM l{h - 1} f JOIN dep ON dep.src = f.node WHERE {before} GROUP BY 1, 2)")
    return ", ".join(out)


@query(f"WITH {DEP_SQL}, {_levels(6)} " + " UNION ALL ".join(f"SELECT source, node AS target, {h} AS length, array_to_string(path, '>') AS path FROM l{h}" for h in range(1, 7)))
def shortest_path_len(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").cast("long").alias("source"))
    edges = dep(spark, d).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    return T.chains_from(edges, sources).withColumn("path", F.array_join("path", ">"))


@query(f"WITH {DEP_SQL}, {_levels(6)}, a AS (" + " UNION ALL ".join(f"SELECT source, node AS target, {h} AS length, array_to_string(path, '>') AS path FROM l{h}" for h in range(1, 7)) + ") SELECT * FROM a WHERE target = source + 50")
def shortest_path_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth part and the one 50 behind it, searched from both ends."""
    pairs = table(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").cast("long").alias("source"), (F.col("p_partkey") + 50).cast("long").alias("target"))
    return T.shortest_chains(dep(spark, d), pairs).select("source", "target", "length", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def _index(spark: SparkSession, d: str) -> A.Adjacency:
    return A.write_index(code_graph(spark, d), f"{shared_dir(spark)}/adjacency")


@query(f"""WITH {CODE_SQL} SELECT src AS id, dst AS other, rel_type, 'out' AS direction FROM code_edges WHERE rel_type LIKE '%_CALLS_%' UNION ALL SELECT dst, src, rel_type, 'in' FROM code_edges WHERE rel_type LIKE '%_CALLS_%'""")
def indexed_calls(spark: SparkSession, d: str) -> DataFrame:
    """Callers and callees of every callable, by the bucketed index."""
    index = _index(spark, d)
    ids = index.nodes.where(F.col("node_type").isin("Function", "Method")).select(F.col("node_id").alias("here"))
    side = lambda out: A.neighbours(index, ids, out, ["FUNCTION_CALLS_FUNCTION", "METHOD_CALLS_METHOD"]).select(F.col("here").alias("id"), F.col("there").alias("other"), "rel_type", F.lit("out" if out else "in").alias("direction"))
    return side(True).unionByName(side(False))


@query(f"""WITH RECURSIVE {CODE_SQL}, e AS (SELECT DISTINCT src, dst FROM code_edges WHERE rel_type = 'FILE_IMPORTS_FILE'), w(start, id, hops) AS (SELECT node_id, node_id, 0 FROM code_nodes WHERE node_type = 'File' UNION SELECT w.start, e.dst, hops + 1 FROM w JOIN e ON e.src = w.id WHERE hops < 3)
SELECT start, id, min(hops) AS hops FROM w GROUP BY 1, 2""")
def indexed_imports(spark: SparkSession, d: str) -> DataFrame:
    """What every file imports within three hops, by the bucketed index."""
    index = _index(spark, d)
    return A.reach(index, index.nodes.where("node_type = 'File'").select(F.col("node_id").alias("start")), 3, rel_types=["FILE_IMPORTS_FILE"])


_TYPED = lambda rel: f"(SELECT DISTINCT src, dst FROM code_edges WHERE rel_type = '{rel}')"


@query(f"""WITH {CODE_SQL} SELECT i.src AS a, i.dst AS b, f.dst AS c, h.dst AS d FROM {_TYPED("FILE_IMPORTS_FILE")} i JOIN {_TYPED("FILE_DEFINES_CLASS")} f ON f.src = i.dst JOIN {_TYPED("CLASS_INHERITS_CLASS")} h ON h.src = f.dst""")
def pattern_path(spark: SparkSession, d: str) -> DataFrame:
    """Files that import a file whose class has a base class."""
    return M.match(code_graph(spark, d).edges, [("a", "FILE_IMPORTS_FILE", "b"), ("b", "FILE_DEFINES_CLASS", "c"), ("c", "CLASS_INHERITS_CLASS", "d")])


@query(f"""WITH {CODE_SQL} SELECT f.src AS a, f.dst AS b, m.dst AS c, h.dst AS d FROM {_TYPED("FILE_DEFINES_CLASS")} f JOIN {_TYPED("CLASS_CONTAINS_METHOD")} m ON m.src = f.dst JOIN {_TYPED("CLASS_INHERITS_CLASS")} h ON h.src = f.dst""")
def pattern_star(spark: SparkSession, d: str) -> DataFrame:
    """Classes with their file, a method and a base class."""
    return M.match(code_graph(spark, d).edges, [("a", "FILE_DEFINES_CLASS", "b"), ("b", "CLASS_CONTAINS_METHOD", "c"), ("b", "CLASS_INHERITS_CLASS", "d")])


@query(f"""WITH {CODE_SQL}, e AS {_TYPED("FILE_IMPORTS_FILE")} SELECT x.src AS a, y.src AS b, z.src AS c FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = y.dst AND z.dst = x.src""")
def pattern_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Files that import one another in a circle of three."""
    return M.match(code_graph(spark, d).edges, [("a", "FILE_IMPORTS_FILE", "b"), ("b", "FILE_IMPORTS_FILE", "c"), ("c", "FILE_IMPORTS_FILE", "a")])
