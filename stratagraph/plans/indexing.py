"""Indexing of a folder, whole or by what has changed since it was indexed before.

Beside the tables that are asked, an index keeps its references (imports, calls, inherits), resolved or not. A later index lists the
tree, takes a digest of each file, and finds changed files by folder. Changed files are parsed, chunked and embedded; references
in them, and those that `operators.changes` names, are resolved anew. Rows that go are marked in bitmaps, and new ones are
written beside the old. Of the graph, the nodes of changed files and the edges that leave a touched file are joined anew: a changed one,
one with a reference that is resolved anew, or one that refers to a changed one.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.functions.vectors import uuid5
from stratagraph.operators import changes as D
from stratagraph.operators import graph as G
from stratagraph.operators import resolution as R
from stratagraph.operators.chunking import build_chunks, embedding_text
from stratagraph.operators.parsing import Parsed, known_paths, parse_unresolved
from stratagraph.plans.scratch import materialize, small
from stratagraph.sources import repository as S
from stratagraph.sources.store import Staged, Store

#: To be raised when parsers, chunks or resolution give other rows: an index of another number is made anew.
RULES = 1
REFERENCES = ("imports", "calls", "inherits")
#: The file that a reference is in, and the one that it is resolved to.
ENDS = {"imports": ("source_file", "resolved_file"), "calls": ("caller_file", "callee_file"), "inherits": ("child_file", "parent_file")}
_TARGETS = {"imports": ["resolved_file"], "calls": ["callee_file", "callee_type"], "inherits": ["parent_file"]}
#: What Spark says of files that are gone or damaged.
UNREADABLE = ("PATH_NOT_FOUND", "FILE_NOT_EXIST", "FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER", "is not a Parquet file", "does not exist")

Embed = Callable[[Column], Column]


@dataclass(frozen=True)
class Indexed:
    """Files read into tables, and references resolved, of all that there are; `whole` where nothing of an index before was kept."""

    whole: bool
    files: int
    references: int


def unreadable(e: Exception) -> bool:
    return any(sign in str(e) for sign in UNREADABLE)


def made_by(spark: SparkSession, embed: Embed) -> DataFrame:
    """One row: the rules and the embedding of an index. An embedding tells itself by its `model`, or else by that of its function."""
    name = getattr(embed, "model", None) or f"{getattr(embed, '__module__', '')}.{getattr(embed, '__qualname__', type(embed).__qualname__)}"
    return spark.createDataFrame([(RULES, str(name))], "rules int, embedding string")


def index(spark: SparkSession, store: Store, repository_id: str, root: str, embed: Embed, state: Callable, full: bool = False) -> Indexed:
    state("parsing")
    tables = store.versions.manifest(repository_id)["tables"]
    stamp = made_by(spark, embed)
    try:
        if not full and {"files", "entities", "chunks", "nodes", "edges", "made_by", *REFERENCES} <= set(tables) and store.versions.rows(tables["made_by"]).collect() == stamp.collect():
            return _amend(spark, store, repository_id, root, embed, state, tables)
    except Exception as e:
        if not unreadable(e):
            raise
        logging.getLogger(__name__).warning("the index of %s cannot be read and is made anew: %s", repository_id, str(e)[:200])
    return _whole(spark, store, repository_id, root, embed, state, stamp)


def _chunks(entities: DataFrame, embed: Embed) -> DataFrame:
    key = F.concat_ws(":", "repository_id", "file_path", "entity_type", "entity_name", F.format_string("%d-%d", "start_line", "end_line"))
    return build_chunks(entities).withColumn("id", uuid5(key)).withColumn("embedding", embed(embedding_text()))


def _languages(files: DataFrame) -> dict[str, int]:
    return {r["language"]: r["n"] for r in S.language_counts(files).collect()}


def _graph(files: DataFrame, entities: DataFrame, refs: dict[str, DataFrame]) -> G.Graph:
    rows = files.select("repository_id", "file_path", F.coalesce("language", F.lit("unknown")).alias("language")).join(entities.select("repository_id", "file_path").distinct(), ["repository_id", "file_path"], "left_semi")
    return G.build_graph(entities, refs["imports"], refs["calls"], refs["inherits"], rows)


def _put_graph(staged: Staged, files: DataFrame, entities: DataFrame, refs: dict[str, DataFrame]) -> None:
    graph = _graph(files, entities, refs)
    staged.put("nodes", graph.nodes)
    staged.put("edges", graph.edges)


def _amend_graph(staged: Staged, tables: dict, paths: DataFrame, files: DataFrame, entities: DataFrame, refs: dict[str, DataFrame], stale: dict[str, DataFrame]) -> None:
    """Nodes of touched files, and edges that leave them, in the place of the stored ones. `refs` are all references as they are now, `paths` the changed files, `stale` the references of other files that are resolved anew.

    An edge depends on the references of the file that it leaves and on the definitions in both its files, and on nothing else. So
    the graph of the touched files, joined with the files that they refer to, holds the edges that leave them as the whole graph does.
    """
    key = ["repository_id", "file_path"]
    sources = [df.select("repository_id", F.col(ENDS[name][0]).alias("file_path")) for name, df in stale.items()]
    for name, (source, target) in ENDS.items():
        sources.append(refs[name].join(paths.withColumnRenamed("file_path", target), ["repository_id", target], "left_semi").select("repository_id", F.col(source).alias("file_path")))
    touched = small(materialize(reduce(DataFrame.unionByName, sources, paths).distinct(), "touched"))
    leaving = {name: materialize(refs[name].join(touched.withColumnRenamed("file_path", source), ["repository_id", source], "left_semi"), f"leaving_{name}") for name, (source, _) in ENDS.items()}
    ends = [df.select("repository_id", F.col(ENDS[name][1]).alias("file_path")).where("file_path is not null") for name, df in leaving.items()]
    needed = small(materialize(reduce(DataFrame.unionByName, ends, touched).distinct(), "needed"))
    # The repository has a node as long as one of its files has an entity, whichever.
    inside = materialize(entities.join(needed, key, "left_semi"), "inside")
    graph = _graph(files.join(needed, key, "left_semi"), inside, leaving)
    repository = G.build_graph(entities.limit(1), *[df.limit(0) for df in leaving.values()]).nodes.where("node_type = 'Repository'")

    def own(nodes: DataFrame) -> DataFrame:
        return nodes.where("node_type <> 'Repository'").join(touched, key, "left_semi").select(*nodes.columns)

    def leave(edges: DataFrame, nodes: DataFrame) -> DataFrame:
        """Edges that leave one of nodes(repository_id, node_id), and the repository's to it."""
        at = F.when(F.col("rel_type") == "REPOSITORY_CONTAINS_FILE", F.col("dst")).otherwise(F.col("src"))
        return edges.withColumn("node_id", at).join(nodes, ["repository_id", "node_id"], "left_semi").select(*edges.columns)

    ids = ["repository_id", "node_id"]
    held, edges = (staged.store.versions.rows(tables[name]) for name in ("nodes", "edges"))
    went = materialize(own(held).select(*ids).unionByName(held.where("node_type = 'Repository'").select(*ids)), "went")
    came = materialize(own(graph.nodes).unionByName(repository.select(*graph.nodes.columns)), "came")
    dead = materialize(leave(edges, small(went)).select("repository_id", "rel_type", "src", "dst"), "dead")
    staged.amend("nodes", tables["nodes"], small(went), came)
    staged.amend("edges", tables["edges"], small(dead), leave(graph.edges, small(came.select(*ids))))


def _uses(refs: dict[str, DataFrame], entities: DataFrame, imports: DataFrame) -> dict[str, DataFrame]:
    """Calls and base classes with their targets, where there are any."""
    return {
        "calls": R.with_targets(refs["calls"], R.resolve_calls(refs["calls"], entities, imports), _TARGETS["calls"]),
        "inherits": R.with_targets(refs["inherits"], R.resolve_inheritance(refs["inherits"], entities, imports), _TARGETS["inherits"]),
    }


def _parts(p: Parsed) -> dict[str, DataFrame]:
    return {"imports": p.imports, "calls": p.calls, "inherits": p.inherits}


def _whole(spark: SparkSession, store: Store, repository_id: str, root: str, embed: Embed, state: Callable, stamp: DataFrame) -> Indexed:
    staged = store.stage(repository_id)
    files = staged.put("files", S.scan(spark, root, repository_id))
    parsed = parse_unresolved(files)
    entities = staged.put("entities", parsed.entities)
    state("creating_embeddings", language_counts=_languages(files))
    staged.put("chunks", _chunks(entities, embed))
    state("building_graph")
    refs = _parts(parsed)
    refs["imports"] = staged.put("imports", R.resolve_imports(parsed.imports, known_paths(entities)))
    refs |= {name: staged.put(name, df) for name, df in _uses(refs, entities, refs["imports"]).items()}
    _put_graph(staged, files, entities, refs)
    staged.put("made_by", stamp)
    staged.commit()
    return Indexed(True, files.count(), sum(df.count() for df in refs.values()))


def _amend(spark: SparkSession, store: Store, repository_id: str, root: str, embed: Embed, state: Callable, tables: dict) -> Indexed:
    old = {name: store.versions.rows(tables[name]) for name in ("files", "entities", *REFERENCES)}
    names = materialize(S.listed_files(spark, root), "names")
    digests = materialize(S.file_rows(root, names, repository_id).select("repository_id", "file_path", "digest"), "digests")
    folders = materialize(D.changed_folders(D.folder_digests(old["files"]), D.folder_digests(digests)), "folders")
    staged = store.stage(repository_id)
    if folders.isEmpty():
        for name, entry in tables.items():
            staged.keep(name, entry)
        state("creating_embeddings", language_counts=_languages(old["files"]))
        staged.commit()
        return Indexed(False, 0, 0)
    changed = materialize(D.changed_files(old["files"], digests, folders), "changed")
    paths = small(changed.select("repository_id", "file_path"))
    here = lambda df, column="file_path": df.join(paths.withColumnRenamed("file_path", column), ["repository_id", column], "left_semi")

    # What is read now is what counts, whatever a file was when its digest was taken.
    wanted = names.join(small(changed.where("change <> 'removed'").select(F.col("file_path").alias("path"))), "path", "left_semi")
    fresh = materialize(S.file_rows(root, wanted, repository_id), "fresh")
    files = staged.amend("files", tables["files"], paths, fresh)
    first = max((df.agg(F.max("seq")).first()[0] or 0) for name, df in old.items() if name != "files") + 1
    parsed = parse_unresolved(fresh, first)
    added = materialize(parsed.entities, "entities")
    gone = materialize(here(old["entities"]).select("repository_id", "seq", "file_path", "entity_type", "entity_name"), "gone")
    entities = staged.amend("entities", tables["entities"], paths, added)
    state("creating_embeddings", language_counts=_languages(files))
    staged.amend("chunks", tables["chunks"], paths, _chunks(added, embed))
    state("building_graph")

    # Imports: those of changed files, and those that could mean a path that came or went.
    moved = materialize(D.changed_paths(known_paths(gone), known_paths(added)), "moved")
    stayed = {"imports": old["imports"].join(paths.withColumnRenamed("file_path", "source_file"), ["repository_id", "source_file"], "left_anti")}
    stale = materialize(D.stale_imports(stayed["imports"], moved), "stale_imports")
    again = parsed.imports.unionByName(stale.select(*parsed.imports.columns))
    resolved = {"imports": materialize(R.resolve_imports(again, known_paths(entities)), "imports")}
    sources = materialize(D.stale_sources(stale, resolved["imports"].join(small(stale.select("repository_id", "seq")), ["repository_id", "seq"], "left_semi")), "sources")

    def amended(name: str, source_file: str, stale: DataFrame) -> DataFrame:
        """Rows of changed files go, stale ones are replaced."""
        keys = here(old[name], source_file).select("repository_id", "seq").unionByName(stale.select("repository_id", "seq"))
        return staged.amend(name, tables[name], small(materialize(keys, "keys")), resolved[name].select(*old[name].columns))

    refs = {"imports": amended("imports", "source_file", stale)}
    # Calls and base classes: those of changed files, of files that import others now, and of names that stand for something else.
    names_changed = materialize(D.changed_names(gone, added), "names_changed")
    picked: dict[str, DataFrame] = {}
    for name, use, source_file, is_class in (("calls", "callee_name", "caller_file", False), ("inherits", "parent_class", "child_file", True)):
        rest = old[name].join(paths.withColumnRenamed("file_path", source_file), ["repository_id", source_file], "left_anti")
        stayed[name] = materialize(D.stale_uses(rest, use, source_file, names_changed.where(F.col("is_class") == is_class), sources), f"stale_{name}")
        new = _parts(parsed)[name]
        picked[name] = materialize(new.unionByName(stayed[name].select(*new.columns)), f"again_{name}")
    used = materialize(picked["calls"].select("repository_id", F.col("callee_name").alias("entity_name")).unionByName(picked["inherits"].select("repository_id", F.col("parent_class").alias("entity_name"))).distinct(), "used")
    meant = entities.select("repository_id", "seq", "file_path", "entity_type", "entity_name").join(small(used), ["repository_id", "entity_name"], "left_semi")
    resolved |= {name: materialize(df, name) for name, df in _uses(picked, meant, refs["imports"]).items()}
    refs |= {"calls": amended("calls", "caller_file", stayed["calls"]), "inherits": amended("inherits", "child_file", stayed["inherits"])}
    _amend_graph(staged, tables, paths, files, entities, refs, {"imports": stale, "calls": stayed["calls"], "inherits": stayed["inherits"]})
    staged.keep("made_by", tables["made_by"])
    staged.commit()
    return Indexed(False, fresh.count(), sum(df.count() for df in resolved.values()))
