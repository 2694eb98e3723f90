"""What a change of files makes stale: changed files by folder digests, and references whose resolution may differ.

Every function takes any number of repositories. Rows of unchanged files are never parsed, and references are resolved anew only
where a rule of `operators.resolution` reads something that differs:
- an import reads which of its candidate paths, and of the paths that end with them, are known;
- a call or a base class reads the definitions of its name, and what its file imports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.operators.resolution import candidates, is_javascript, python_candidates
from stratagraph.plans.scratch import small

#: Hexadecimal digits of a digest that are added up as one number; four of them hold the digest.
_PIECE = 15


def _folders(path: Column) -> Column:
    """Every folder that a path lies in, the root ('') included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def folder_digests(files: DataFrame) -> DataFrame:
    """files(repository_id, file_path, digest) -> (repository_id, folder, files, digest): a digest of all that is below each folder.

    The digest of a folder is made of the sums of the digests of its files with their paths, so folders are one aggregate that
    combines before it shuffles, and the order of the files is of no account. Two folders of one path and digest hold the same files.
    """
    mark = F.sha2(F.concat_ws(":", "file_path", "digest"), 256)
    pieces = [F.conv(F.substring(mark, 1 + _PIECE * i, _PIECE), 16, 10).cast("decimal(20,0)") for i in range(4)]
    rows = files.select("repository_id", F.explode(_folders(F.col("file_path"))).alias("folder"), *[p.alias(f"__{i}") for i, p in enumerate(pieces)])
    sums = rows.groupBy("repository_id", "folder").agg(F.count("*").alias("files"), *[F.sum(f"__{i}").alias(f"__{i}") for i in range(4)])
    return sums.select("repository_id", "folder", "files", F.sha2(F.concat_ws(":", *[F.col(f"__{i}").cast("string") for i in range(4)]), 256).alias("digest"))


def changed_folders(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repository_id, folder) whose digests in two results of `folder_digests` differ, or that one of them lacks."""
    both = old.select("repository_id", "folder", F.col("digest").alias("__old")).join(new.select("repository_id", "folder", F.col("digest").alias("__new")), ["repository_id", "folder"], "full")
    return both.where(~F.col("__old").eqNullSafe(F.col("__new"))).select("repository_id", "folder")


def changed_files(old: DataFrame, new: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """(repository_id, file_path, change) of files(repository_id, file_path, digest): added, removed, or changed. Files of folders that are not in `folders` are not compared."""
    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.select("repository_id", "file_path", F.col("digest").alias(name))
        if folders is None:
            return rows
        within = F.regexp_replace("file_path", "/?[^/]*$", "").alias("folder")
        return rows.select("*", within).join(small(folders), ["repository_id", "folder"], "left_semi").drop("folder")

    both = side(old, "__old").join(side(new, "__new"), ["repository_id", "file_path"], "full")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") != F.col("__new"), "changed")
    return both.select("repository_id", "file_path", change.alias("change")).where("change is not null")


def changed_names(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repository_id, name, is_class) whose definitions differ between two sets of entities(repository_id, seq, file_path, entity_type, entity_name) of the same files.

    A body, a signature or a line that differs is no difference: only what a name stands for in each file counts.
    """
    def defined(df: DataFrame, name: str) -> DataFrame:
        kinds = F.transform(F.array_sort(F.collect_list(F.struct("seq", "entity_type"))), lambda x: x["entity_type"])
        rows = df.where(F.col("entity_type").isin("class", "function", "method")).withColumn("is_class", F.col("entity_type") == "class")
        return rows.groupBy("repository_id", "file_path", F.col("entity_name").alias("name"), "is_class").agg(kinds.alias(name))

    both = defined(old, "__old").join(defined(new, "__new"), ["repository_id", "file_path", "name", "is_class"], "full")
    return both.where(~F.col("__old").eqNullSafe(F.col("__new"))).select("repository_id", "name", "is_class").distinct()


def changed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repository_id, path) that only one of two sets of (repository_id, path) has."""
    return old.exceptAll(new).unionByName(new.exceptAll(old)).distinct()


def stale_imports(imports: DataFrame, moved: DataFrame) -> DataFrame:
    """Rows of imports(repository_id, seq, source_file, module, imported_names, is_relative) that could mean one of moved(repository_id, path), or could have meant it."""
    js = is_javascript(F.col("source_file"))
    leaf = F.flatten(F.transform("imported_names", lambda n: python_candidates(F.concat_ws(".", F.when(F.col("module") != "", F.col("module")), n), F.col("source_file"))))
    none = F.array().cast("array<string>")
    tried = F.concat(candidates(F.col("module"), F.col("source_file")), F.when(~js & ~F.col("is_relative"), leaf).otherwise(none))
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    suffixes = moved.select("repository_id", F.explode(ends).alias("__tried")).distinct()
    hit = imports.select("repository_id", "seq", F.explode(F.coalesce(tried, none)).alias("__tried")).join(small(suffixes), ["repository_id", "__tried"], "left_semi")
    return imports.join(hit.select("repository_id", "seq").distinct(), ["repository_id", "seq"], "left_semi")


def stale_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repository_id, source_file) whose set of imported files differs between two sets of resolved imports of the same rows."""
    def pairs(df: DataFrame) -> DataFrame:
        return df.where("resolved_file is not null").select("repository_id", "source_file", "resolved_file").distinct()

    a, b = pairs(old), pairs(new)
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select("repository_id", "source_file").distinct()


def with_stale(uses: DataFrame, name: str, source_file: str, names: DataFrame, sources: DataFrame) -> DataFrame:
    """uses with boolean stale: its `name` is one of names(repository_id, name), or its `source_file` one of sources(repository_id, source_file)."""
    named = small(names.select("repository_id", F.col("name").alias(name), F.lit(True).alias("__named")).distinct())
    moved = small(sources.select("repository_id", F.col("source_file").alias(source_file), F.lit(True).alias("__moved")).distinct())
    told = uses.join(named, ["repository_id", name], "left").join(moved, ["repository_id", source_file], "left")
    return told.select(*uses.columns, (F.col("__named").isNotNull() | F.col("__moved").isNotNull()).alias("stale"))


def stale_uses(uses: DataFrame, name: str, source_file: str, names: DataFrame, sources: DataFrame) -> DataFrame:
    """The stale rows of `with_stale`."""
    return with_stale(uses, name, source_file, names, sources).where("stale").drop("stale")
