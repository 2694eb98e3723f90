"""Name resolution with priorities and ambiguity rules, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.plans.scratch import materialize, small

# Fixed values.
JS_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
UNLINKED_CALLS = [
    "print", "len", "str", "int", "float", "bool", "list", "dict", "set", "tuple", "range", "isinstance", "getattr", "setattr", "hasattr", "super", "open", "sorted", "enumerate", "zip", "map", "filter", "format", "append", "extend", "get",
    "items", "keys", "values", "join", "split", "strip", "add", "update",
]


def is_javascript(source_file: Column) -> Column:
    return F.lower(source_file).rlike("(" + "|".join(e.replace(".", r"\.") for e in JS_EXTENSIONS) + ")$")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def python_candidates(module: Column, source_file: Column) -> Column:
    """Paths that a dotted module may stand for, most specific first; leading dots climb from the importing file's folder."""
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.array_join(F.filter(F.split(F.regexp_replace(module, r"^\.+", ""), r"\."), lambda p: p != ""), "/")
    parts = F.filter(F.split(_folder(source_file), "/"), lambda p: p != "")
    up = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - dots + 1, F.lit(0))), "/")
    relative = F.concat_ws("/", F.when(up != "", up), F.when(rest != "", rest))
    stem = F.when(dots > 0, relative).otherwise(F.regexp_replace(module, r"\.", "/"))
    both = F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py")))
    return F.when((module == "") | module.isNull() | (stem == ""), F.array().cast("array<string>")).otherwise(both)


def javascript_candidates(module: Column, source_file: Column) -> Column:
    """R2: paths that a relative specifier may stand for; `.` and `..` are folded as text. Bare specifiers have none."""
    parts = F.split(F.concat_ws("/", _folder(source_file), module), "/")
    step = lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    stem = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    ext = F.regexp_extract(stem, r"[^/](\.[^./]+)$", 1)
    bare = stem.substr(F.lit(1), F.length(stem) - F.length(ext))
    siblings = F.concat(F.array(stem), F.array(*[F.concat(bare, F.lit(e)) for e in JS_EXTENSIONS]))
    guesses = F.array(*[F.concat(stem, F.lit(e)) for e in JS_EXTENSIONS], *[F.concat(stem, F.lit(f"/index{e}")) for e in JS_EXTENSIONS])
    found = F.array_distinct(F.when(ext.isin(JS_EXTENSIONS), siblings).otherwise(guesses))
    return F.when(~module.startswith(".") | (stem == ""), F.array().cast("array<string>")).otherwise(found)


def candidates(module: Column, source_file: Column) -> Column:
    """R3."""
    return F.when(is_javascript(source_file), javascript_candidates(module, source_file)).otherwise(python_candidates(module, source_file))


def _suffix_index(known: DataFrame) -> DataFrame:
    """(repository_id, suffix, path, n): every proper path suffix of the known files, with the number of files that end so.

    The theta join `path ends with /candidate` becomes an equi-join: a path has as many suffixes as folders.
    """
    parts = F.split("path", "/")
    tails = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).otherwise(F.array().cast("array<string>"))
    exploded = known.select("repository_id", "path", F.explode(tails).alias("suffix"))
    return exploded.groupBy("repository_id", "suffix").agg(F.min("path").alias("path"), F.count("*").alias("n"))


def resolve_imports(imports: DataFrame, known_files: DataFrame) -> DataFrame:
    """imports(repository_id, seq, source_file, module, imported_names, is_relative, ...) with resolved_file.

    By candidate in order: an exact file, else (Python only) the one file that ends so. Absolute Python imports that stay
    open try module.name for each imported name, where exact and suffix matches count together and must be one. A file
    never imports itself. known_files: (repository_id, path), files with at least one entity.
    """
    known = known_files.select("repository_id", "path").distinct()
    suffixes = _suffix_index(known)
    keys = ["repository_id", "seq"]
    js = is_javascript(F.col("source_file"))
    base = imports.select(*keys, "source_file", js.alias("__js"), candidates(F.col("module"), F.col("source_file")).alias("__c"))
    tries = base.select(*keys, "__js", F.posexplode("__c").alias("__n", "suffix"))
    exact = known.select("repository_id", F.col("path").alias("suffix"), F.col("path").alias("__exact"))
    matched = tries.join(exact, ["repository_id", "suffix"], "left").join(suffixes.where("n = 1").select("repository_id", "suffix", "path"), ["repository_id", "suffix"], "left")
    hit = F.coalesce("__exact", F.when(~F.col("__js"), F.col("path")))
    direct = matched.groupBy(*keys).agg(F.min_by(hit, F.when(hit.isNotNull(), F.col("__n"))).alias("__direct"))
    # Leaf modules: `from package import module`.
    leaf = imports.where(~js & ~F.col("is_relative")).select(*keys, "source_file", "module", F.posexplode("imported_names").alias("__k", "__name"))
    leaf = leaf.select(*keys, "__k", F.posexplode(python_candidates(F.concat_ws(".", F.when(F.col("module") != "", F.col("module")), "__name"), F.col("source_file"))).alias("__n", "suffix"))
    both = leaf.join(exact, ["repository_id", "suffix"], "left").join(suffixes, ["repository_id", "suffix"], "left")
    total = F.coalesce("n", F.lit(0)) + F.col("__exact").isNotNull().cast("int")
    only = F.when(total == 1, F.coalesce("__exact", "path"))
    leaves = both.groupBy(*keys).agg(F.min_by(only, F.when(only.isNotNull(), F.struct("__k", "__n"))).alias("__leaf"))
    out = imports.drop("resolved_file").join(direct, keys, "left").join(leaves, keys, "left")
    chosen = F.coalesce("__direct", "__leaf")
    return out.withColumn("resolved_file", F.when(chosen != F.col("source_file"), chosen)).drop("__direct", "__leaf")


def targets_of(asked: DataFrame, entities: DataFrame, imports: DataFrame) -> DataFrame:
    """Distinct asked(repository_id, source_file, name) -> (repository_id, source_file, name, target_file, target_type) of those with a target, written.

    The first definition in the same file; else the only one in files that the source imports; else the only one
    at all; else none. entities(repository_id, seq, file_path, entity_type, entity_name). Definitions are counted by file
    before they meet anything, and what a name means in a file is found once, however often it is used there.
    """
    seen = imports.where("resolved_file is not null").select("repository_id", "source_file", F.col("resolved_file").alias("file_path")).distinct()
    defs = entities.select("repository_id", F.col("entity_name").alias("name"), "file_path", "entity_type", "seq")
    # Numbers only, so that rows combine by hash before they are shuffled; types are few.
    kinds = defs.groupBy("repository_id", "name", "file_path", "entity_type").agg(F.count("*").alias("__n"), F.min("seq").alias("__seq"))
    kinds = materialize(kinds, "definitions")
    per = kinds.groupBy("repository_id", "name", "file_path").agg(F.sum("__n").alias("__n"), F.min_by("entity_type", "__seq").alias("__type"))
    # A name defined everywhere would multiply its uses; what the rules need of it is one count and one file.
    single = per.groupBy("repository_id", "name").agg(F.sum("__n").alias("__n"), F.min("file_path").alias("__file"), F.min("__type").alias("__atype")).where("__n = 1").drop("__n")
    own = per.select("repository_id", "name", F.col("file_path").alias("source_file"), F.col("__type").alias("__own"))
    by_import = (
        asked.join(seen, ["repository_id", "source_file"]).join(per, ["repository_id", "name", "file_path"]).groupBy("repository_id", "source_file", "name")
        .agg(F.sum("__n").alias("__n"), F.min("file_path").alias("__ifile"), F.min("__type").alias("__itype")).where("__n = 1").drop("__n")
    )
    joined = asked.join(own, ["repository_id", "name", "source_file"], "left").join(by_import, ["repository_id", "name", "source_file"], "left").join(single, ["repository_id", "name"], "left")
    same, via = F.col("__own").isNotNull(), F.col("__ifile").isNotNull()
    out = joined.select(
        "repository_id", "source_file", "name",
        F.when(same, F.col("source_file")).when(via, F.col("__ifile")).otherwise(F.col("__file")).alias("target_file"),
        F.when(same, F.col("__own")).when(via, F.col("__itype")).otherwise(F.col("__atype")).alias("target_type"),
    )
    return materialize(out.where("target_file is not null"), "targets")


def resolve_calls(calls: DataFrame, entities: DataFrame, imports: DataFrame, every: bool = False) -> DataFrame:
    """calls(repository_id, seq, caller_file, caller_name, caller_type, callee_name, line) whose callee is defined here, with callee_file and callee_type; direct recursion is dropped.

    every: all calls in the same order of columns, the two null where a call has no callee here.
    """
    linked = ~F.col("callee_name").isin(UNLINKED_CALLS)
    asked = materialize(calls.where(linked).select("repository_id", F.col("caller_file").alias("source_file"), F.col("callee_name").alias("name")).distinct(), "names_called")
    found = targets_of(asked, entities.where(F.col("entity_type").isin("function", "method")), imports)
    found = small(found.select("repository_id", F.col("source_file").alias("caller_file"), F.col("name").alias("callee_name"), F.col("target_file").alias("callee_file"), F.col("target_type").alias("callee_type")))
    bare = calls.drop("callee_file", "callee_type")
    itself = (F.col("callee_file") == F.col("caller_file")) & (F.col("callee_name") == F.col("caller_name"))
    columns = ["repository_id", "seq", *[c for c in bare.columns if c not in ("repository_id", "seq")]]
    if not every:
        return bare.join(found, ["repository_id", "caller_file", "callee_name"]).where(~itself).select(*columns, "callee_file", "callee_type")
    gone = F.coalesce(itself, F.lit(False))
    out = bare.join(found, ["repository_id", "caller_file", "callee_name"], "left")
    return out.select(*columns, *[F.when(~gone, F.col(c)).alias(c) for c in ("callee_file", "callee_type")])


def resolve_inheritance(inherits: DataFrame, entities: DataFrame, imports: DataFrame) -> DataFrame:
    """inherits(repository_id, seq, child_file, child_class, parent_class) whose parent is defined here, with parent_file."""
    bare = inherits.drop("parent_file")
    asked = materialize(bare.select("repository_id", F.col("child_file").alias("source_file"), F.col("parent_class").alias("name")).distinct(), "names_inherited")
    found = targets_of(asked, entities.where("entity_type = 'class'"), imports)
    found = small(found.select("repository_id", F.col("source_file").alias("child_file"), F.col("name").alias("parent_class"), F.col("target_file").alias("parent_file")))
    columns = ["repository_id", "seq", *[c for c in bare.columns if c not in ("repository_id", "seq")]]
    return bare.join(found, ["repository_id", "child_file", "parent_class"]).select(*columns, "parent_file")


def with_targets(references: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """All references, with the target columns of those that are found, and null ones for the rest."""
    return references.drop(*columns).join(found.select("repository_id", "seq", *columns), ["repository_id", "seq"], "left")
