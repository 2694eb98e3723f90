"""Queries over graph facts and vector retrieval at the tables' scale, with their SQL.

The graph is that of `tables.code_graph`. Each region's repository is asked for the same names and files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.operators import facts as H
from stratagraph.operators.graph import Graph
from stratagraph.plans.registry import query
from stratagraph.plans.retrieval_queries import RANKED_SQL
from stratagraph.plans.tables import CODE_SQL, code_graph, table

NAMES = ["C5", "f7", "m3", "C11", "nothing"]
CLASSES = [f"C{k}" for k in range(37)]
FILES = [f"src/nation_{k}.py" for k in range(25)] + ["src/none.py"]
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_ASKED = "asked AS (SELECT CAST(r_regionkey AS INT) AS question_id, r_name AS rid, CAST(k - 1 AS INT) AS name_pos, {0}[k] AS asked FROM region, (SELECT unnest(range(1, {1} + 1)) AS k))"
_NAMED = f"{CODE_SQL}, {_ASKED.format(_LIST(NAMES), len(NAMES))}"
_CLASSES = f"{CODE_SQL}, {_ASKED.format(_LIST(CLASSES), len(CLASSES))}"
_PATHS = f"{CODE_SQL}, {_ASKED.format(_LIST(FILES), len(FILES))}"


def _asked(spark: SparkSession, d: str, values: list[str]) -> DataFrame:
    none = F.array().cast("array<string>")
    regions = table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("question_id"), F.col("r_name").alias("repository_id"))
    return regions.select("question_id", "repository_id", none.alias("intents"), F.lit(False).alias("is_flow"), F.posexplode(F.array(*[F.lit(v) for v in values])).alias("name_pos", "asked"))


def _graph(spark: SparkSession, d: str) -> Graph:
    """The graph, written once: generators read nodes and edges several times."""
    return code_graph(spark, d, write=True)


def _facts(source: str, step: int, tier: int, score: float, relationship: str, path: str = "file_path", kind: str = "lower(node_type)", name: str = "name", where: str = "TRUE") -> str:
    """The last SELECT: an item and a fact a row, as every generator gives them."""
    return f"""SELECT question_id, CAST({step} AS INT) AS step, CAST(name_pos AS INT) AS name_pos, CAST(row_pos AS INT) AS row_pos, fact, coalesce({path}, '') AS file_path, {kind} AS entity_type, coalesce({name}, '') AS entity_name,
coalesce(start_line, 0) AS start_line, coalesce(end_line, 0) AS end_line, CAST({score} AS DOUBLE) AS score, CAST({tier} AS INT) AS tier, {relationship} AS relationship FROM {source} WHERE {where}"""


_AT = "file_path || ':' || start_line || '-' || end_line"


@query(f"""WITH {_NAMED}, r AS (SELECT a.question_id, a.name_pos, n.*, row_number() OVER (PARTITION BY question_id, name_pos ORDER BY list_position(['Class', 'Function', 'Method'], node_type), file_path, start_line, node_id) AS row_pos,
lower(node_type) || ' ' || concat_ws('.', class_name, n.name) || ' is defined at ' || {_AT} AS fact FROM asked a JOIN code_nodes n ON n.repository_id = a.rid AND n.name = a.asked WHERE node_type IN ('Class', 'Function', 'Method'))
{_facts('r', 1, 0, 1.0, "'definition'", where='row_pos <= 5')}""")
def facts_definitions(spark: SparkSession, d: str) -> DataFrame:
    return H.definitions(H.resolve(_asked(spark, d, NAMES), _graph(spark, d))[0])


def _called(here: str, there: str, fact: str) -> str:
    return f"""l AS (SELECT DISTINCT a.question_id, a.name_pos, a.asked, o.node_id AS other, o.node_type, o.name, o.file_path, o.start_line, o.end_line FROM asked a JOIN code_nodes n ON n.repository_id = a.rid AND n.name = a.asked AND n.node_type IN ('Function', 'Method')
JOIN code_edges e ON e.repository_id = a.rid AND e.{here} = n.node_id AND e.rel_type IN ('FUNCTION_CALLS_FUNCTION', 'METHOD_CALLS_METHOD') JOIN code_nodes o ON o.repository_id = a.rid AND o.node_id = e.{there}),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id, name_pos ORDER BY file_path, start_line, other) AS row_pos, {fact} AS fact FROM l)"""


@query(f"""WITH {_NAMED}, {_called('dst', 'src', f"lower(node_type) || ' ' || name || ' (' || {_AT} || ') calls ' || asked")} {_facts('r', 3, 1, 0.9, "'calls ' || asked", where='row_pos <= 12')}""")
def facts_callers(spark: SparkSession, d: str) -> DataFrame:
    return H.callers(H.resolve(_asked(spark, d, NAMES), _graph(spark, d))[1])


@query(f"""WITH {_NAMED}, {_called('src', 'dst', f"asked || ' calls ' || name || ' (' || {_AT} || ')'")} {_facts('r', 4, 1, 0.9, "'called by ' || asked", where='row_pos <= 12')}""")
def facts_callees(spark: SparkSession, d: str) -> DataFrame:
    return H.callees(H.resolve(_asked(spark, d, NAMES), _graph(spark, d))[1])


def _class_links(rel: str, here: str, there: str) -> str:
    return f"""SELECT DISTINCT a.question_id, a.name_pos, a.asked, n.node_id AS owner, n.file_path AS owner_file, n.start_line AS owner_start, n.end_line AS owner_end, o.node_id AS other, o.name, o.file_path, o.start_line, o.end_line
FROM asked a JOIN code_nodes n ON n.repository_id = a.rid AND n.name = a.asked AND n.node_type = 'Class' JOIN code_edges e ON e.repository_id = a.rid AND e.{here} = n.node_id AND e.rel_type = '{rel}' JOIN code_nodes o ON o.repository_id = a.rid AND o.node_id = e.{there}"""


def _heirs(table_name: str, here: str, there: str, head: str, shift: int) -> str:
    return f"""{table_name}l AS ({_class_links('CLASS_INHERITS_CLASS', here, there)}),
{table_name}t AS (SELECT question_id, name_pos, owner, {head} || string_agg(name || ' (' || file_path || ')', ', ' ORDER BY name || ' (' || file_path || ')') AS fact FROM {table_name}l GROUP BY question_id, name_pos, owner, asked),
{table_name}n AS (SELECT *, row_number() OVER (PARTITION BY question_id, name_pos ORDER BY owner, name, other) + {shift} AS row_pos FROM {table_name}l),
{table_name} AS (SELECT n.*, CASE WHEN row_number() OVER (PARTITION BY n.question_id, n.name_pos, n.owner ORDER BY row_pos) = 1 THEN t.fact END AS fact FROM {table_name}n n JOIN {table_name}t t USING (question_id, name_pos, owner))"""


@query(f"""WITH {_CLASSES}, {_heirs('up', 'src', 'dst', "'class ' || asked || ' inherits from '", 0)}, {_heirs('down', 'dst', 'src', "'classes inheriting from ' || asked || ': '", 1000)}
{_facts('up', 5, 1, 0.9, "'base class of ' || asked", kind="'class'")} UNION ALL {_facts('down', 5, 1, 0.9, "'subclass of ' || asked", kind="'class'")}""")
def facts_inheritance(spark: SparkSession, d: str) -> DataFrame:
    return H.inheritance(H.resolve(_asked(spark, d, CLASSES), _graph(spark, d))[1])


@query(f"""WITH {_CLASSES}, l AS ({_class_links('CLASS_CONTAINS_METHOD', 'src', 'dst')}),
t AS (SELECT question_id, name_pos, owner, 'class ' || min(asked) || ' (' || min(owner_file) || ':' || min(owner_start) || '-' || min(owner_end) || ') defines: ' || string_agg(name, ', ' ORDER BY name) AS text FROM l GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY question_id, name_pos, owner ORDER BY start_line, other) AS n FROM l),
r AS (SELECT n.*, row_number() OVER (PARTITION BY question_id, name_pos ORDER BY owner, n) AS row_pos, CASE WHEN n = 1 THEN text END AS fact FROM n JOIN t USING (question_id, name_pos, owner) WHERE n <= 12)
{_facts('r', 2, 3, 0.7, "'method of ' || asked", kind="'method'")}""")
def facts_class_structure(spark: SparkSession, d: str) -> DataFrame:
    return H.class_structure(H.resolve(_asked(spark, d, CLASSES), _graph(spark, d))[1])


@query(f"""WITH {_PATHS}, e AS (SELECT DISTINCT repository_id AS rid, substring(src, 6) AS s, substring(dst, 6) AS d FROM code_edges WHERE rel_type = 'FILE_IMPORTS_FILE'),
l AS (SELECT question_id, name_pos, asked, 0 AS k, s AS path FROM asked JOIN e ON e.rid = asked.rid AND d = asked UNION ALL SELECT question_id, name_pos, asked, 1, d FROM asked JOIN e ON e.rid = asked.rid AND s = asked),
n AS (SELECT *, row_number() OVER (PARTITION BY question_id, name_pos, k ORDER BY path) AS n FROM l),
t AS (SELECT question_id, name_pos, k, min(asked) || CASE WHEN k = 0 THEN ' is imported by: ' ELSE ' imports: ' END || string_agg(path, ', ' ORDER BY path) AS text FROM n WHERE n <= 12 GROUP BY 1, 2, 3),
r AS (SELECT n.*, row_number() OVER (PARTITION BY question_id, name_pos ORDER BY k, path) AS row_pos, CASE WHEN n = 1 THEN text END AS fact FROM n JOIN t USING (question_id, name_pos, k)),
x AS (SELECT *, CASE WHEN row_pos <= 12 THEN path END AS p, NULL AS start_line, NULL AS end_line FROM r WHERE row_pos <= 24 AND (row_pos <= 12 OR fact IS NOT NULL))
{_facts('x', 6, 2, 0.6, "CASE WHEN k = 0 THEN 'imports ' ELSE 'imported by ' END || asked", path='p', kind="'file'", name='p')}""")
def facts_file_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return H.file_dependencies(_asked(spark, d, FILES), _graph(spark, d))


@query(f"""WITH {_PATHS}, l AS (SELECT a.question_id, a.name_pos, a.asked, n.* FROM asked a JOIN code_nodes n ON n.repository_id = a.rid AND n.file_path = a.asked WHERE node_type IN ('Class', 'Function')),
t AS (SELECT question_id, name_pos, min(asked) || ' defines ' || concat_ws('; ', 'classes ' || string_agg(name, ', ' ORDER BY name) FILTER (node_type = 'Class'), 'functions ' || string_agg(name, ', ' ORDER BY name) FILTER (node_type = 'Function')) AS text FROM l GROUP BY 1, 2),
n AS (SELECT l.*, text, row_number() OVER (PARTITION BY question_id, name_pos ORDER BY node_type, start_line, node_id) AS row_pos FROM l JOIN t USING (question_id, name_pos)), r AS (SELECT *, CASE WHEN row_pos = 1 THEN text END AS fact FROM n)
{_facts('r', 7, 3, 0.7, "'defined in ' || asked")}""")
def facts_file_contents(spark: SparkSession, d: str) -> DataFrame:
    return H.file_contents(_asked(spark, d, FILES), _graph(spark, d))


@query(f"""WITH {CODE_SQL}, e AS (SELECT DISTINCT repository_id AS rid, substring(src, 6) AS s, substring(dst, 6) AS d FROM code_edges WHERE rel_type = 'FILE_IMPORTS_FILE'),
i AS (SELECT rid, d AS path, count(*) AS n FROM e GROUP BY 1, 2), o AS (SELECT rid, s AS path, count(*) AS n FROM e GROUP BY 1, 2),
c AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY n DESC, path) AS row_pos FROM i), s AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY n DESC, path) AS row_pos FROM o WHERE lower(path) LIKE '%.py' AND NOT EXISTS (SELECT 1 FROM i WHERE i.rid = o.rid AND i.path = o.path)),
ct AS (SELECT rid, 'Files imported most: ' || string_agg(path || ' (' || n || ' importers)', ', ' ORDER BY row_pos) AS text FROM c WHERE row_pos <= 8 GROUP BY 1), st AS (SELECT rid, 'Files that import and are never imported: ' || string_agg(path, ', ' ORDER BY row_pos) AS text FROM s WHERE row_pos <= 6 GROUP BY 1),
x AS (SELECT CAST(r_regionkey AS INT) AS question_id, 0 AS name_pos, row_pos, CASE WHEN row_pos = 1 THEN text END AS fact, path, 'imported by ' || n || ' files' AS rel, NULL AS start_line, NULL AS end_line FROM region JOIN c ON c.rid = r_name JOIN ct ON ct.rid = r_name WHERE row_pos <= 5
UNION ALL SELECT CAST(r_regionkey AS INT), 0, row_pos + 100, CASE WHEN row_pos = 1 THEN text END, path, 'entry point', NULL, NULL FROM region JOIN s ON s.rid = r_name JOIN st ON st.rid = r_name WHERE row_pos <= 4)
{_facts('x', 8, 2, 0.6, 'rel', path='path', kind="'file'", name='path')}""")
def facts_architecture(spark: SparkSession, d: str) -> DataFrame:
    return H.architecture(_asked(spark, d, ["x"]).select("question_id", "repository_id"), _graph(spark, d))


@query(f"""WITH {CODE_SQL}, h AS (SELECT CAST(r_regionkey AS INT) AS question_id, r_name AS rid, k AS position, ['C5', 'f7', 'm3', 'C11'][k] AS asked FROM region, (SELECT unnest([1, 2, 3]) AS k)),
b AS (SELECT repository_id, src AS here, dst AS there, rel_type, '->' AS arrow FROM code_edges UNION ALL SELECT repository_id, dst, src, rel_type, '<-' FROM code_edges),
l AS (SELECT DISTINCT question_id, position AS name_pos, asked, rel_type, arrow, o.* FROM h JOIN code_nodes n ON n.repository_id = h.rid AND n.name = h.asked AND n.node_type IN ('Class', 'Function', 'Method') JOIN b ON b.repository_id = h.rid AND b.here = n.node_id JOIN code_nodes o ON o.repository_id = h.rid AND o.node_id = b.there),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id, name_pos ORDER BY arrow, rel_type, node_id) AS row_pos, asked || ' ' || arrow || ' ' || rel_type || ' ' || arrow || ' ' || name || CASE WHEN coalesce(file_path, '') <> '' THEN ' (' || file_path || ')' ELSE '' END AS fact FROM l)
{_facts('r', 20, 1, 0.65, "rel_type || ' ' || asked", where='row_pos <= 8')}""")
def facts_expansion(spark: SparkSession, d: str) -> DataFrame:
    hits = _asked(spark, d, ["C5", "f7", "m3", "C11"]).select("question_id", "repository_id", (F.col("name_pos") + 1).alias("position"), F.lit("function").alias("entity_type"), F.col("asked").alias("entity_name"))
    return H.expansion(hits, _graph(spark, d))


@query("""WITH s AS (SELECT CAST(q.vec_id AS INT) AS question_id, 'v' || e.vec_id || '.py' AS file_path, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0),
h AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, file_path) AS rank FROM s), t AS (SELECT *, CASE WHEN rank <= 3 THEN 0 ELSE 3 END AS tier FROM h WHERE rank <= 20),
w AS (SELECT *, round(CASE tier WHEN 0 THEN 1.0 ELSE 0.5 END::DOUBLE * greatest(score, 0.01::DOUBLE), 9) AS weighted FROM t), p AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY weighted DESC, tier, file_path, rank) AS position FROM w)
SELECT question_id, file_path, score, CAST(tier AS INT) AS tier, 'semantic match, rank ' || rank AS reason, weighted, CAST(position AS INT) AS position FROM p WHERE position <= 12""")
def vector_only(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    line = F.lit(1)
    chunks = vectors.select(
        F.lit("r").alias("repository_id"), F.format_string("v%d.py", "vec_id").alias("file_path"), F.lit("function").alias("entity_type"), F.col("vec_id").cast("string").alias("entity_name"), line.alias("start_line"), line.alias("end_line"),
        F.lit("").alias("content"), F.lit("python").alias("language"), F.col("embedding"),
    )
    questions = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").cast("int").alias("question_id"), F.lit("r").alias("repository_id"), F.to_json("embedding").alias("question"))
    out = H.vector_only(questions, chunks, lambda c: F.from_json(c, "array<double>"))
    return out.select("question_id", "file_path", "score", "tier", "reason", "weighted", "position")


@query(f"""WITH {CODE_SQL}, q AS (SELECT CAST(vec_id AS INT) AS question_id, r_name AS rid, 'f' || (vec_id // 100 % 101) AS asked, embedding FROM embeddings JOIN region ON r_regionkey = vec_id // 100 % 5 WHERE vec_id % 100 = 0),
c AS (SELECT r_name AS rid, 'v' || vec_id || '.py' AS file_path, 'C' || (vec_id % 37) AS entity_name, embedding FROM embeddings JOIN region ON r_regionkey = vec_id % 5),
s AS (SELECT question_id, q.rid, c.file_path, c.entity_name, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score FROM q JOIN c ON c.rid = q.rid),
v AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, file_path, entity_name) AS rank FROM s QUALIFY rank <= 16),
df AS (SELECT question_id, n.file_path, n.name, n.start_line, n.end_line, row_number() OVER (PARTITION BY question_id ORDER BY list_position(['Class', 'Function', 'Method'], node_type), n.file_path, n.start_line, node_id) AS row_pos FROM q JOIN code_nodes n ON n.repository_id = q.rid AND n.name = q.asked AND node_type IN ('Class', 'Function', 'Method') QUALIFY row_pos <= 5),
b AS (SELECT repository_id, src AS here, dst AS there, rel_type, '->' AS arrow FROM code_edges UNION ALL SELECT repository_id, dst, src, rel_type, '<-' FROM code_edges),
l AS (SELECT DISTINCT question_id, rank AS name_pos, v.entity_name AS asked, rel_type, arrow, o.node_id, o.name, o.file_path, o.start_line, o.end_line FROM v JOIN code_nodes n ON v.rank <= 3 AND n.repository_id = v.rid AND n.name = v.entity_name AND n.node_type IN ('Class', 'Function', 'Method') JOIN b ON b.repository_id = v.rid AND b.here = n.node_id JOIN code_nodes o ON o.repository_id = v.rid AND o.node_id = b.there),
ex AS (SELECT *, row_number() OVER (PARTITION BY question_id, name_pos ORDER BY arrow, rel_type, node_id) AS row_pos FROM l QUALIFY row_pos <= 8),
u AS (SELECT question_id, file_path, entity_name, 1 AS start_line, 9 AS end_line, score, 'vector' AS source, CASE WHEN rank <= 3 THEN 0 ELSE 3 END AS tier, '' AS relationship, 0 AS o0, rank AS o1, 0 AS o2, 0 AS o3 FROM v
UNION ALL SELECT question_id, file_path, name, start_line, end_line, 1.0::DOUBLE, 'graph', 0, 'definition', 1, 1, 0, row_pos FROM df
UNION ALL SELECT question_id, file_path, name, coalesce(start_line, 0), coalesce(end_line, 0), 0.65::DOUBLE, 'graph', 1, rel_type || ' ' || asked, 1, 20, name_pos, row_pos FROM ex WHERE coalesce(file_path, '') <> ''),
items AS (SELECT *, '' AS content, row_number() OVER (PARTITION BY question_id ORDER BY o0, o1, o2, o3) AS seq FROM u), {RANKED_SQL}
SELECT question_id, file_path, entity_name, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, score, source, CAST(tier AS INT) AS tier, relationship, weighted, CAST(position AS INT) AS position FROM final WHERE position <= 12""")
def hybrid_tables(spark: SparkSession, d: str) -> DataFrame:
    """Both retrievers over the tables: every hundredth vector asks about a function of its repository, with the vector as the question's embedding."""
    vectors = table(spark, d, "embeddings")
    names = F.broadcast(table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("r"), F.col("r_name").alias("repository_id")))
    chunks = vectors.withColumn("r", F.col("vec_id") % 5).join(names, "r").select(
        "repository_id", F.format_string("v%d.py", "vec_id").alias("file_path"), F.lit("class").alias("entity_type"), F.format_string("C%d", F.col("vec_id") % 37).alias("entity_name"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"),
        F.lit("").alias("content"), F.lit("python").alias("language"), "embedding",
    )
    turn = F.expr("vec_id div 100")
    asked = vectors.where("vec_id % 100 = 0").withColumn("r", turn % 5).join(names, "r")
    text = F.concat(F.format_string("Explain how does `f%d` work ", turn % 101), F.to_json("embedding"))
    asked = asked.select(F.col("vec_id").cast("int").alias("question_id"), "repository_id", text.alias("question"))
    out = H.retrieve(asked, chunks, _graph(spark, d), embed=lambda c: F.from_json(F.regexp_extract(c, r"(\[.*\])", 1), "array<double>"), partial=False)
    return out.ranked.select("question_id", "file_path", "entity_name", "start_line", "end_line", "score", "source", "tier", "relationship", "weighted", "position")
