"""Queries of what has changed between two states of a tree, and of references that are resolved anew, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.operators import changes as D
from stratagraph.operators import resolution as R
from stratagraph.plans.registry import query
from stratagraph.plans.scratch import materialize, small
from stratagraph.plans.tables import CODE_SQL, code_rows, table


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files of some hundred folders, and the same after edits in a tenth of the folders: files that are gone, changed, or moved."""
    i = F.col("doc_id")
    edited = i % 97 < 10
    path = F.concat(F.lit("d"), (i % 97).cast("string"), F.lit("/e"), (i % 7).cast("string"), F.lit("/f"), i.cast("string"), F.lit(".txt"))
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shown = lambda df, p, text: df.select(F.lit("r").alias("repository_id"), p.alias("file_path"), F.sha2(text.cast("binary"), 256).alias("digest"))
    moved = F.when(edited & (i % 50 == 3), F.concat(F.lit("moved/f"), i.cast("string"), F.lit(".txt"))).otherwise(path)
    after = shown(docs.where(~(edited & (i % 50 == 1))), moved, F.when(edited & (i % 50 == 2), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return materialize(shown(docs, path, F.col("text")), "before"), materialize(after, "after")


_CHANGES = """i AS (SELECT doc_id, 'd' || (doc_id % 97) || '/e' || (doc_id % 7) || '/f' || doc_id || '.txt' AS path FROM documents WHERE doc_id % 97 < 10),
x AS (SELECT path AS file_path, 'removed' AS change FROM i WHERE doc_id % 50 IN (1, 3) UNION ALL SELECT path, 'changed' FROM i WHERE doc_id % 50 = 2 UNION ALL SELECT 'moved/f' || doc_id || '.txt', 'added' FROM i WHERE doc_id % 50 = 3)"""


@query(f"WITH {_CHANGES} SELECT file_path, change FROM x")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files are compared in folders whose digests differ only."""
    before, after = _states(spark, d)
    folders = D.changed_folders(D.folder_digests(before), D.folder_digests(after))
    return D.changed_files(before, after, materialize(folders, "folders")).select("file_path", "change")


@query(f"""WITH {_CHANGES} SELECT DISTINCT array_to_string(p[:n], '/') AS folder FROM (SELECT p, unnest(range(0, len(p))) AS n FROM (SELECT string_split(file_path, '/') AS p FROM x))""")
def changed_folders(spark: SparkSession, d: str) -> DataFrame:
    """A folder's digest tells of everything below it."""
    before, after = _states(spark, d)
    return D.changed_folders(D.folder_digests(before), D.folder_digests(after)).select("folder")


@query(f"""WITH {CODE_SQL},
d AS (SELECT rid, path, name FROM (SELECT c_custkey AS key, rid, path, 'f' || (c_custkey % 101) AS name FROM cu UNION ALL SELECT o, rid, path, 'm' || (o % 13) FROM od) JOIN place p USING (rid, path) WHERE NOT (p.k % 5 = 0 AND key % 7 = 0)
UNION ALL SELECT rid, path, 'f' || (101 + k // 5) FROM place WHERE k % 5 = 0),
s AS (SELECT DISTINCT rid, path AS src, target AS path FROM od WHERE target IS NOT NULL AND target <> (SELECT path FROM place WHERE k = 7)),
own AS (SELECT DISTINCT rid, path AS src, name FROM d), per AS (SELECT rid, path, name, count(*) AS n FROM d GROUP BY ALL),
via AS (SELECT rid, src, name, max(path) AS path FROM s JOIN per USING (rid, path) GROUP BY ALL HAVING sum(n) = 1), one AS (SELECT rid, name, max(path) AS path FROM d GROUP BY ALL HAVING count(*) = 1),
u AS (SELECT rid, o AS id, path AS src, CASE WHEN o % 2 = 0 THEN 'm' || (o % 17) ELSE 'f' || (c % 107) END AS name, CASE WHEN o % 3 = 0 THEN 'm' || (c % 13) ELSE 'f' || (c % 101) END AS who FROM od),
t AS (SELECT u.*, CASE WHEN own.src IS NOT NULL THEN u.src ELSE coalesce(via.path, one.path) END AS target FROM u LEFT JOIN own USING (rid, src, name) LEFT JOIN via USING (rid, src, name) LEFT JOIN one USING (rid, name))
SELECT rid AS repository_id, CAST(id AS BIGINT) AS seq, name AS callee_name, target AS callee_file FROM t WHERE target IS NOT NULL AND NOT (target = src AND name = who)""")
def reindex_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls of `code_rows`, resolved, then brought up to date after every fifth file has lost and gained definitions and one file cannot be imported any more; SQL resolves all of them."""
    _, entities, imports, calls, _ = code_rows(spark, d)
    entities = materialize(entities.where("entity_type <> 'class'").select("repository_id", "seq", "file_path", "entity_type", "entity_name"), "entities")
    nations = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("repository_id"), F.concat(F.lit("src/"), F.lower("n_name"), F.lit(".py")).alias("file_path"))
    changed = materialize(nations.where("n_nationkey % 5 = 0"), "changed")
    paths = small(changed.select("repository_id", "file_path"))
    gone = materialize(entities.join(paths, ["repository_id", "file_path"], "left_semi"), "gone")
    gained = changed.select("repository_id", F.lit(0).cast("long").alias("seq"), "file_path", F.lit("function").alias("entity_type"), F.concat(F.lit("f"), (101 + F.floor(F.col("n_nationkey") / 5)).cast("string")).alias("entity_name"))
    added = materialize(gone.where("seq % 7 <> 0").unionByName(gained), "added")
    after = entities.join(paths, ["repository_id", "file_path"], "left_anti").unionByName(added)
    lost = small(nations.where("n_nationkey = 7").select(F.col("file_path").alias("resolved_file"), F.lit(True).alias("lost")))
    # What a file imports is all that is read of its imports: one row a pair of files.
    imports = materialize(imports.select("repository_id", "source_file", "resolved_file").distinct(), "imports")
    imports_after = imports.join(lost, "resolved_file", "left").withColumn("resolved_file", F.when(F.col("lost").isNull(), F.col("resolved_file"))).drop("lost")

    raw = calls.select("repository_id", "seq", "caller_file", "caller_name", "callee_name", "line", F.lit(None).cast("string").alias("callee_file"), F.lit(None).cast("string").alias("callee_type"))
    stored = R.resolve_calls(raw, entities, imports, every=True)
    sources = materialize(D.stale_sources(imports, imports_after), "sources")
    names = materialize(D.changed_names(gone, added).where("not is_class"), "names")
    # Calls inside changed files are stale whatever they name, and others by what has changed; all are told apart in the pass that stores them.
    inside = paths.select("repository_id", F.col("file_path").alias("source_file"))
    told = materialize(D.with_stale(stored, "callee_name", "caller_file", names, sources.unionByName(inside)), "stored")
    again = R.resolve_calls(told.where("stale").drop("stale"), after, imports_after)
    kept = told.where("not stale").drop("stale")
    return kept.unionByName(again.select(*kept.columns)).where("callee_file is not null").select("repository_id", "seq", "callee_name", "callee_file")
