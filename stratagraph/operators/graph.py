"""Property-graph build (G0-G8) and one-hop reads (Q1-Q10, Q12, Q13, Q15, Q16, Q18, Q19).

nodes(repository_id, node_id, node_type, file_path, class_name, name, language, signature, docstring, start_line, end_line)
edges(repository_id, rel_type, src, dst, module, line); node ids are `type:path[:class]:name`.
Reads take edges with (src, dst) and work on any graph.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.plans.scratch import TASK_ROWS, materialize, small, spread

#: Label order of name lookups.
LABELS = ("Class", "Function", "Method")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def node_id(kind: str | Column, *parts: str | Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat_ws(":", kind, *[F.col(p) if isinstance(p, str) else p for p in parts])


def _last(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """B1: rows of one key are merged, the last written wins."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__v")).select(*keys, *[F.col(f"__v.{c}").alias(c) for c in rest])


def _newest(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """`_last` of many rows a key: the newest number of each key is written, as numbers combine by hash, and only rows that have it are sorted.

    Keys that are too many to broadcast are merged at once. df is read twice.
    """
    top = materialize(df.groupBy(*keys).agg(F.max(order).alias(order)), "newest")
    if top.count() <= TASK_ROWS:
        held = F.broadcast(top.select(*[F.col(c).alias(f"__{c}") for c in (*keys, order)]))
        df = df.join(held, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*keys, order)]), "left_semi")
    return _last(df, keys, order)


def callable_index(nodes: DataFrame) -> DataFrame:
    """Q18: one node for each (repository, file, name) among callables; functions win over methods, the first method is kept."""
    order = F.struct(F.when(F.col("node_type") == "Function", 0).otherwise(1), "start_line", "node_id")
    return nodes.where(F.col("node_type").isin("Function", "Method")).groupBy("repository_id", "file_path", "name").agg(
        F.min_by("node_id", order).alias("node_id"), F.min_by("node_type", order).alias("node_type")
    )


def build_graph(entities: DataFrame, imports: DataFrame, calls: DataFrame, inherits: DataFrame, files: DataFrame | None = None, write: bool = False) -> Graph:
    """G0-G8 from resolved rows; unresolved edges, and edges whose ends are no nodes, are left out.

    files: (repository_id, file_path, language); by default the files of the entities, first language by seq.
    write: nodes are written before edges are made of them, and edges too, for graphs that are read several times.
    """
    keep = (lambda df, name: materialize(df, name)) if write else (lambda df, name: df)
    few = small if write else (lambda df: df)
    given = files is not None
    if not given:
        files = entities.groupBy("repository_id", "file_path").agg(F.min_by("language", "seq").alias("language"))
    files = files.dropDuplicates(["repository_id", "file_path"])
    none = lambda t="string": F.lit(None).cast(t)
    cols = ["repository_id", "node_id", "node_type", "file_path", "class_name", "name", "language", "signature", "docstring", "start_line", "end_line"]

    def shaped(df: DataFrame, kind: str, ident: Column, **given: Column) -> DataFrame:
        have = set(df.columns)
        out = {c: F.col(c) if c in have else none("int" if c.endswith("line") else "string") for c in cols}
        return df.select(*[({"node_id": ident, "node_type": F.lit(kind)} | given).get(c, out[c]).alias(c) for c in cols])

    own = entities.withColumn("name", F.col("entity_name"))
    own = own.select(*[c for c in own.columns if c in {*cols, "parent_name", "entity_type", "seq"}])  # no source texts through the merge
    if given:
        own = own.join(few(files.select("repository_id", "file_path")), ["repository_id", "file_path"], "left_semi")
    # Only methods are told apart by their class; one that names none is no node.
    method = F.col("entity_type") == "method"
    own = own.where(F.col("entity_type").isin("class", "function") | (method & F.col("parent_name").isNotNull()))
    own = own.withColumn("class_name", F.when(method, F.col("parent_name"))).drop("parent_name")
    merged = (_newest if write else _last)(own, ["repository_id", "file_path", "entity_type", "class_name", "name"])
    of = lambda kind: merged.where(F.col("entity_type") == kind)
    methods, classes, functions = of("method"), of("class"), of("function")
    repositories = files.select("repository_id").distinct()
    nodes = keep(
        shaped(repositories, "Repository", node_id("Repository", "repository_id"), name=F.col("repository_id"))
        .unionByName(shaped(files, "File", node_id("File", "file_path"), name=F.element_at(F.split("file_path", "/"), -1)))
        .unionByName(shaped(classes, "Class", node_id("Class", "file_path", "name")))
        .unionByName(shaped(functions, "Function", node_id("Function", "file_path", "name")))
        .unionByName(shaped(methods, "Method", node_id("Method", "file_path", "class_name", "name"))),
        "nodes",
    )

    def edge(df: DataFrame, rel: str | Column, src: Column, dst: Column, module: Column | None = None, line: Column | None = None) -> DataFrame:
        rel = F.lit(rel) if isinstance(rel, str) else rel
        return df.select("repository_id", rel.alias("rel_type"), src.alias("src"), dst.alias("dst"), (none() if module is None else module).alias("module"), (none("int") if line is None else line).alias("line"))

    node = lambda kind: nodes.where(F.col("node_type") == kind)
    file_of, this = node_id("File", "file_path"), F.col("node_id")
    index = few(keep(callable_index(nodes), "callables"))
    class_keys = few(node("Class").select("repository_id", "file_path", F.col("name").alias("class_name")))
    known = few(node("File").select("repository_id", F.col("file_path").alias("__f")))
    # Imports and calls are merged by what they join, before they join it: by numbers first, which combine by hash.
    imported = imports.where(F.col("resolved_file").isNotNull()).groupBy("repository_id", "source_file", "resolved_file", "module").agg(F.max_by("line", "seq").alias("line"), F.max("seq").alias("seq"))
    imported = _last(imported, ["repository_id", "source_file", "resolved_file"])
    for c in ("source_file", "resolved_file"):
        imported = imported.join(known.withColumnRenamed("__f", c), ["repository_id", c], "left_semi")
    caller = index.select("repository_id", F.col("file_path").alias("caller_file"), F.col("name").alias("caller_name"), F.col("node_id").alias("src"), F.col("node_type").alias("st"))
    callee = index.select("repository_id", F.col("file_path").alias("callee_file"), F.col("name").alias("callee_name"), F.col("node_id").alias("dst"), F.col("node_type").alias("dt"))
    called = calls.where(F.col("callee_file").isNotNull()).join(known.withColumnRenamed("__f", "callee_file"), ["repository_id", "callee_file"], "left_semi")
    called = called.groupBy("repository_id", "caller_file", "caller_name", "callee_file", "callee_name").agg(F.max_by("line", "seq").alias("line"))
    called = called.join(caller, ["repository_id", "caller_file", "caller_name"]).join(callee, ["repository_id", "callee_file", "callee_name"])
    both = F.when((F.col("st") == "Method") & (F.col("dt") == "Method"), "METHOD_CALLS_METHOD").otherwise("FUNCTION_CALLS_FUNCTION")
    child = class_keys.select("repository_id", F.col("file_path").alias("child_file"), F.col("class_name").alias("child_class"))
    parent = class_keys.select("repository_id", F.col("file_path").alias("parent_file"), F.col("class_name").alias("parent_class"))
    inherited = inherits.where(F.col("parent_file").isNotNull()).select("repository_id", "child_file", "child_class", "parent_file", "parent_class").distinct()
    inherited = inherited.join(child, ["repository_id", "child_file", "child_class"], "left_semi").join(parent, ["repository_id", "parent_file", "parent_class"], "left_semi")
    edges = (
        edge(node("File"), "REPOSITORY_CONTAINS_FILE", node_id("Repository", "repository_id"), this)
        .unionByName(edge(node("Class"), "FILE_DEFINES_CLASS", file_of, this))
        .unionByName(edge(node("Function"), "FILE_DEFINES_FUNCTION", file_of, this))
        .unionByName(edge(node("Method"), "FILE_DEFINES_METHOD", file_of, this))
        .unionByName(edge(node("Method").join(class_keys, ["repository_id", "file_path", "class_name"], "left_semi"), "CLASS_CONTAINS_METHOD", node_id("Class", "file_path", "class_name"), this))
        .unionByName(edge(imported, "FILE_IMPORTS_FILE", node_id("File", "source_file"), node_id("File", "resolved_file"), F.col("module"), F.col("line")))
        .unionByName(edge(called, both, F.col("src"), F.col("dst"), line=F.col("line")))
        .unionByName(edge(inherited, "CLASS_INHERITS_CLASS", node_id("Class", "child_file", "child_class"), node_id("Class", "parent_file", "parent_class")))
    )
    return Graph(nodes, keep(edges, "edges"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Q2: counts per node type and edge type, with totals (kind, type null)."""
    count = lambda df, col, kind: df.rollup(F.col(col).alias("type")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return count(nodes, "node_type", "node").unionByName(count(edges, "rel_type", "edge"))


def overview(files: DataFrame, classes: DataFrame, functions: DataFrame, key: str = "file_path") -> DataFrame:
    """Q1: per file the distinct class and function names; each side is aggregated before it is joined."""
    names = lambda df, out: df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias(out))
    return files.join(names(classes, "classes"), key, "left").join(names(functions, "functions"), key, "left").select(
        *files.columns, F.coalesce("classes", F.lit("")).alias("classes"), F.coalesce("functions", F.lit("")).alias("functions")
    )


def contents(nodes: DataFrame, file_path: str | None = None) -> DataFrame:
    """Q4: a file's classes, functions and methods as ordered struct lists, or those of every file; no row for a path without a file."""
    here = nodes.where(F.col("file_path").isNotNull() if file_path is None else F.col("file_path") == file_path)
    pick = lambda kind: F.array_sort(F.collect_list(F.when(F.col("node_type") == kind, F.struct("start_line", "name", "class_name", "signature"))))
    return here.groupBy("repository_id", "file_path").agg(pick("Class").alias("classes"), pick("Function").alias("functions"), pick("Method").alias("methods"), F.max((F.col("node_type") == "File").cast("int")).alias("__f")).where("__f = 1").drop("__f")


def files_of(nodes: DataFrame, repository_id: str | None = None) -> DataFrame:
    """Q3: (repository_id, file_path, language) of the files, by path."""
    files = nodes.where("node_type = 'File'").select("repository_id", "file_path", "language")
    return (files if repository_id is None else files.where(F.col("repository_id") == repository_id)).orderBy("repository_id", "file_path")


def class_info(nodes: DataFrame, edges: DataFrame, name: str | None = None) -> DataFrame:
    """Q5: for each class of that name, or each class, its methods, bases and subclasses (edge-exact)."""
    classes = nodes.where(F.col("node_type") == "Class").where(F.lit(True) if name is None else F.col("name") == name).select("repository_id", "node_id", "file_path", "name", "start_line", "end_line")
    label = nodes.select("repository_id", F.col("node_id").alias("other"), F.struct(F.col("name").alias("name"), F.col("file_path").alias("file_path")).alias("item"))

    def side(rel: str, here: str, there: str, out: str) -> DataFrame:
        return edges.where(F.col("rel_type") == rel).select("repository_id", F.col(here).alias("node_id"), F.col(there).alias("other")).join(label, ["repository_id", "other"]).groupBy("repository_id", "node_id").agg(F.array_sort(F.collect_set("item")).alias(out))

    on = ["repository_id", "node_id"]
    return classes.join(side("CLASS_CONTAINS_METHOD", "src", "dst", "methods"), on, "left").join(side("CLASS_INHERITS_CLASS", "src", "dst", "bases"), on, "left").join(side("CLASS_INHERITS_CLASS", "dst", "src", "subclasses"), on, "left")


def sources_of(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Q6, Q8: distinct (target, id) with an edge id -> target."""
    return edges.select(F.col("dst").alias("target"), F.col("src").alias("id")).join(small(targets.distinct()), "target", "left_semi").distinct()


def targets_of(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Q7, Q9: distinct (source, id) with an edge source -> id."""
    return edges.select(F.col("src").alias("source"), F.col("dst").alias("id")).join(small(sources.distinct()), "source", "left_semi").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Q19: (id, out_degree, in_degree) over unique edges, in one shuffle of the ends."""
    unique = edges.select("src", "dst").distinct()
    ends = unique.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def central(edges: DataFrame, k: int) -> DataFrame:
    """Q16: the k nodes with most distinct sources, ties to the smaller id."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("in_degree")).orderBy(F.desc("in_degree"), "id").limit(k)


def entry_points(edges: DataFrame, k: int) -> DataFrame:
    """Q15: nodes with targets but no source, most targets first."""
    return degrees(edges).where("in_degree = 0").select("id", F.col("out_degree").alias("imports")).orderBy(F.desc("imports"), "id").limit(k)


def network(edges: DataFrame, definitions: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Q10: (top-k connected nodes with degrees, distinct definition count, total and truncated; edges among them).

    definitions: (id, definition). k is a display limit, so the top nodes are broadcast.
    """
    unique = edges.select("src", "dst").distinct()
    deg = degrees(unique)
    top = deg.orderBy(F.desc(F.col("in_degree") + F.col("out_degree")), "id").limit(k)
    counts = definitions.join(F.broadcast(top.select("id")), "id", "left_semi").groupBy("id").agg(F.count_distinct("definition").alias("definitions"))
    total = deg.agg(F.count("*").alias("total_nodes"))
    nodes = top.join(counts, "id", "left").crossJoin(F.broadcast(total)).select("id", "in_degree", "out_degree", F.coalesce("definitions", F.lit(0).cast("long")).alias("definitions"), "total_nodes", (F.col("total_nodes") > k).alias("truncated"))
    ids = F.broadcast(top.select("id"))
    induced = unique.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, induced


def find_entities(nodes: DataFrame, names: DataFrame, limit: int, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Q12: exact names among the labels; by label priority, then file, line and id; `limit` rows a name."""
    priority = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("node_type"))
    hits = nodes.where(F.col("node_type").isin(*labels)).join(small(names.distinct()), "name", "left_semi")
    order = Window.partitionBy("name").orderBy(priority, *[c for c in ("file_path", "start_line", "node_id") if c in nodes.columns])
    return hits.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def neighbourhood(edges: DataFrame, seeds: DataFrame, limit: int, rows: int | None = None) -> DataFrame:
    """Q13: distinct one-hop neighbours in both directions with relation and direction; `limit` rows a seed, by direction, relation and id.

    rows: about how many edges there are; if given, edges are dealt out by their seed once, in tasks that do not grow with them.
    """
    out = edges.select(F.col("src").alias("seed"), F.col("dst").alias("id"), "rel_type", F.lit("out").alias("direction"))
    into = edges.select(F.col("dst").alias("seed"), F.col("src").alias("id"), "rel_type", F.lit("in").alias("direction"))
    both = out.unionByName(into)
    near = (both if rows is None else spread(both, 2 * rows, "seed")).join(small(seeds.distinct()), "seed", "left_semi").distinct()
    order = Window.partitionBy("seed").orderBy("direction", "rel_type", "id")
    return near.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
