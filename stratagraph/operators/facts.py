"""Graph facts and items for a batch of analysed questions (F1-F11), expansion around hits, and hybrid retrieval (H1, H2).

questions: analysed rows (question_id, repository_id, question, intents, identifiers, file_paths, is_flow, ...).
Each generator returns rows (question_id, step, name_pos, row_pos, fact, file_path, entity_type, entity_name, start_line, end_line,
score, tier, relationship); a row holds an item, a fact, or both. Order is (step, name_pos, row_pos).
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.operators import graph as G
from stratagraph.operators import ranking as R
from stratagraph.operators import vector_search as V
from stratagraph.operators.questions import analyse, vector_limit
from stratagraph.plans.scratch import materialize, small

PER_QUERY, DEFINITIONS, SEEDS, NEIGHBOURS = 12, 5, 3, 8
CENTRAL_FACT, CENTRAL_ITEMS, ENTRY_FACT, ENTRY_ITEMS = 8, 5, 6, 4
CALLS = ["FUNCTION_CALLS_FUNCTION", "METHOD_CALLS_METHOD"]


def _item(step: int, fact: Column, tier: int, relationship: Column, score: float, path: str = "file_path", kind: str | Column = "node_type", name: str | Column = "name", row_pos: str = "row_pos") -> list[Column]:
    """nulls to defaults, lower-case type, integer lines."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return [
        F.col("question_id"), F.lit(step).alias("step"), F.col("name_pos"), F.col(row_pos).cast("int").alias("row_pos"), fact.alias("fact"), F.coalesce(F.col(path), F.lit("")).alias("file_path"), F.lower(col(kind)).alias("entity_type"),
        F.coalesce(col(name), F.lit("")).alias("entity_name"), F.coalesce("start_line", F.lit(0)).cast("int").alias("start_line"), F.coalesce("end_line", F.lit(0)).cast("int").alias("end_line"), F.lit(score).alias("score"), F.lit(tier).alias("tier"), relationship.alias("relationship"),
    ]


def _named(questions: DataFrame, column: str = "identifiers") -> DataFrame:
    return questions.select("question_id", "repository_id", "intents", "is_flow", F.posexplode(column).alias("name_pos", "asked"))


def _where() -> Column:
    return F.format_string("%s:%d-%d", "file_path", "start_line", "end_line")


def _first(df: DataFrame, n: int, *order) -> DataFrame:
    return df.withColumn("row_pos", F.row_number().over(Window.partitionBy("question_id", "name_pos").orderBy(*order))).where(F.col("row_pos") <= n)


def resolve(asked: DataFrame, g: G.Graph, calls: bool = True) -> tuple[DataFrame, DataFrame]:
    """(hits, links) of the names asked for, written: their nodes, and each node's edges in both directions with the node at the other end.

    All generators that go by names read these, so nodes and edges are joined once, whatever a question asks for.
    links: owner and owner_* are the named node, out tells the edge's direction, the other columns are the node there.
    calls: if False, only names with a true `calls` get the links of functions and methods; those of classes are always there.
    """
    place = ["node_type", "name", "file_path", "start_line", "end_line"]
    who = [c for c in asked.columns if c != "repository_id"]
    named = small(asked.select("repository_id", *who))
    hits = g.nodes.join(named, (g.nodes["repository_id"] == named["repository_id"]) & (g.nodes["name"] == named["asked"])).drop(named["repository_id"])
    hits = materialize(hits.select("repository_id", *who, "node_id", "class_name", *place), "named")
    linked = hits if calls else hits.where((F.col("node_type") == "Class") | F.col("calls"))
    ids = small(linked.select("repository_id", F.col("node_id").alias("owner")).distinct())
    edges = g.edges.select("repository_id", "src", "dst", "rel_type")
    near = lambda here, there, out: edges.withColumnRenamed(here, "owner").withColumnRenamed(there, "other").join(ids, ["repository_id", "owner"], "left_semi").select("repository_id", "owner", "other", "rel_type", F.lit(out).alias("out"))
    near = materialize(near("src", "dst", True).unionByName(near("dst", "src", False)).distinct(), "near")
    others = g.nodes.join(small(near.select("repository_id", F.col("other").alias("node_id")).distinct()), ["repository_id", "node_id"], "left_semi").select("repository_id", F.col("node_id").alias("other"), *place)
    owner = linked.select("repository_id", *who, F.col("node_id").alias("owner"), F.col("node_type").alias("owner_type"), F.col("file_path").alias("owner_file"), F.col("start_line").alias("owner_start"), F.col("end_line").alias("owner_end"))
    links = small(owner).join(near, ["repository_id", "owner"]).join(others, ["repository_id", "other"])
    return hits, materialize(links, "named_links")


def definitions(hits: DataFrame) -> DataFrame:
    """F1."""
    top = _first(hits.where(F.col("node_type").isin(*G.LABELS)), DEFINITIONS, F.array_position(F.array(*[F.lit(x) for x in G.LABELS]), F.col("node_type")), "file_path", "start_line", "node_id")
    qualified = F.concat_ws(".", "class_name", "name")
    return top.select(*_item(1, F.concat_ws(" ", F.lower("node_type"), qualified, F.lit("is defined at"), _where()), V.TIER_DIRECT, F.lit("definition"), 1.0))


def _calls(links: DataFrame, step: int, out: bool, fact, relationship) -> DataFrame:
    callable_ = lambda c: F.col(c).isin("Function", "Method")
    rows = links.where(F.col("rel_type").isin(CALLS) & (F.col("out") == out) & callable_("owner_type") & callable_("node_type"))
    rows = rows.select("question_id", "name_pos", "asked", "other", "node_type", "name", "file_path", "start_line", "end_line").distinct()
    return _first(rows, PER_QUERY, "file_path", "start_line", "other").select(*_item(step, fact, V.TIER_RELATED, relationship, 0.9))


def callers(links: DataFrame, step: int = 3) -> DataFrame:
    """F2."""
    fact = F.concat(F.lower("node_type"), F.lit(" "), "name", F.lit(" ("), _where(), F.lit(") calls "), "asked")
    return _calls(links, step, False, fact, F.concat(F.lit("calls "), "asked"))


def callees(links: DataFrame, step: int = 4) -> DataFrame:
    """F3."""
    fact = F.concat("asked", F.lit(" calls "), "name", F.lit(" ("), _where(), F.lit(")"))
    return _calls(links, step, True, fact, F.concat(F.lit("called by "), "asked"))


def _classes(links: DataFrame, rel: str, out: bool) -> DataFrame:
    """Class asked for (owner_*) with the nodes at the other end of an edge."""
    return links.where((F.col("rel_type") == rel) & (F.col("out") == out) & (F.col("owner_type") == "Class"))


def _listed(c: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_list(c)), ", ")


def inheritance(links: DataFrame) -> DataFrame:
    """bases, then subclasses, of each class of the name."""
    out = []
    for k, (there, head, rel) in enumerate(((True, "class %s inherits from ", "base class of "), (False, "classes inheriting from %s: ", "subclass of "))):
        rows = _classes(links, "CLASS_INHERITS_CLASS", there)
        label = F.concat("name", F.lit(" ("), "file_path", F.lit(")"))
        text = rows.groupBy("question_id", "name_pos", "owner").agg(F.concat(F.format_string(head, F.first("asked")), _listed(label)).alias("fact"))
        one = rows.withColumn("row_pos", F.row_number().over(Window.partitionBy("question_id", "name_pos").orderBy("owner", "name", "other")) + 1000 * k)
        first = F.row_number().over(Window.partitionBy("question_id", "name_pos", "owner").orderBy("row_pos")) == 1
        joined = one.withColumn("__first", first).join(text, ["question_id", "name_pos", "owner"]).withColumn("fact", F.when(F.col("__first"), F.col("fact")))
        out.append(joined.select(*_item(5, F.col("fact"), V.TIER_RELATED, F.concat(F.lit(rel), "asked"), 0.9, kind=F.lit("class"))))
    return out[0].unionByName(out[1])


def class_structure(links: DataFrame) -> DataFrame:
    """F5."""
    rows = _classes(links, "CLASS_CONTAINS_METHOD", True)
    head = F.concat(F.lit("class "), F.first("asked"), F.lit(" ("), F.format_string("%s:%d-%d", F.first("owner_file"), F.first("owner_start"), F.first("owner_end")), F.lit(") defines: "))
    text = rows.groupBy("question_id", "name_pos", "owner").agg(F.concat(head, _listed(F.col("name"))).alias("fact"))
    nth = F.row_number().over(Window.partitionBy("question_id", "name_pos", "owner").orderBy("start_line", "other"))
    one = rows.withColumn("__n", nth).where(F.col("__n") <= PER_QUERY).join(text, ["question_id", "name_pos", "owner"])
    one = one.withColumn("row_pos", F.row_number().over(Window.partitionBy("question_id", "name_pos").orderBy("owner", "__n"))).withColumn("fact", F.when(F.col("__n") == 1, F.col("fact")))
    return one.select(*_item(2, F.col("fact"), V.TIER_FILE, F.concat(F.lit("method of "), "asked"), 0.7))


def file_dependencies(asked: DataFrame, g: G.Graph) -> DataFrame:
    """importers first, then imported files; labels name their target; 12 items together."""
    edges = g.edges.where("rel_type = 'FILE_IMPORTS_FILE'").select("repository_id", F.regexp_replace("src", "^File:", "").alias("s"), F.regexp_replace("dst", "^File:", "").alias("d")).distinct()
    into = asked.join(edges.withColumnRenamed("d", "asked").withColumnRenamed("s", "path"), ["repository_id", "asked"]).withColumn("k", F.lit(0))
    out = asked.join(edges.withColumnRenamed("s", "asked").withColumnRenamed("d", "path"), ["repository_id", "asked"]).withColumn("k", F.lit(1))
    rows = into.unionByName(out).withColumn("__n", F.row_number().over(Window.partitionBy("question_id", "name_pos", "k").orderBy("path")))
    shown = rows.where(F.col("__n") <= PER_QUERY).groupBy("question_id", "name_pos", "k").agg(F.concat(F.first("asked"), F.when(F.first("k") == 0, " is imported by: ").otherwise(" imports: "), _listed(F.col("path"))).alias("fact"))
    top = _first(rows.join(shown, ["question_id", "name_pos", "k"]), 2 * PER_QUERY, "k", "path")
    rel = F.when(F.col("k") == 0, F.concat(F.lit("imports "), "asked")).otherwise(F.concat(F.lit("imported by "), "asked"))
    listed = top.withColumn("fact", F.when(F.col("__n") == 1, F.col("fact"))).withColumn("start_line", F.lit(0)).withColumn("end_line", F.lit(0))
    kept = listed.where((F.col("row_pos") <= PER_QUERY) | F.col("fact").isNotNull())
    # A fact whose item falls behind the limit stays, without the item.
    path = F.when(F.col("row_pos") <= PER_QUERY, F.col("path"))
    return kept.withColumn("path", path).select(*_item(6, F.col("fact"), V.TIER_DEPENDENCY, rel, 0.6, path="path", kind=F.lit("file"), name="path"))


def file_contents(asked: DataFrame, g: G.Graph) -> DataFrame:
    """classes, then functions, of a file."""
    inside = g.nodes.where(F.col("node_type").isin("Class", "Function")).select("repository_id", F.col("file_path").alias("asked"), "node_type", "name", "start_line", "end_line", "node_id")
    rows = asked.join(inside, ["repository_id", "asked"])
    names = lambda kind: F.array_sort(F.collect_list(F.when(F.col("node_type") == kind, F.col("name"))))
    text = rows.groupBy("question_id", "name_pos").agg(names("Class").alias("c"), names("Function").alias("f"), F.first("asked").alias("p"))
    part = lambda c, head: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(c, ", ")))
    text = text.select("question_id", "name_pos", F.concat(F.col("p"), F.lit(" defines "), F.concat_ws("; ", part("c", "classes "), part("f", "functions "))).alias("fact"))
    one = rows.withColumn("row_pos", F.row_number().over(Window.partitionBy("question_id", "name_pos").orderBy("node_type", "start_line", "node_id"))).join(text, ["question_id", "name_pos"])
    one = one.withColumn("fact", F.when(F.col("row_pos") == 1, F.col("fact"))).withColumn("file_path", F.col("asked"))
    return one.select(*_item(7, F.col("fact"), V.TIER_FILE, F.concat(F.lit("defined in "), "asked"), 0.7))


def architecture(questions: DataFrame, g: G.Graph) -> DataFrame:
    """F8: most imported files and likely entry points of each question's repository."""
    edges = g.edges.where("rel_type = 'FILE_IMPORTS_FILE'").select("repository_id", F.regexp_replace("src", "^File:", "").alias("src"), F.regexp_replace("dst", "^File:", "").alias("dst")).distinct()
    per = Window.partitionBy("repository_id")
    into = edges.groupBy("repository_id", F.col("dst").alias("path")).agg(F.count("*").alias("n"))
    central = into.withColumn("row_pos", F.row_number().over(per.orderBy(F.desc("n"), "path"))).where(F.col("row_pos") <= CENTRAL_FACT)
    out = edges.groupBy("repository_id", F.col("src").alias("path")).agg(F.count("*").alias("n"))
    entry = out.where(F.lower("path").endswith(".py")).join(into.select("repository_id", "path"), ["repository_id", "path"], "left_anti").withColumn("row_pos", F.row_number().over(per.orderBy(F.desc("n"), "path"))).where(F.col("row_pos") <= ENTRY_FACT)
    q = questions.select("question_id", "repository_id", F.lit(0).alias("name_pos"))

    def rows(found: DataFrame, head: str, label: Column, rel: Column, items: int, shift: int) -> DataFrame:
        text = F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_pos", label.alias("t")))), lambda x: x["t"]), ", "))
        facts = found.groupBy("repository_id").agg(text.alias("fact"))
        one = q.join(found.where(F.col("row_pos") <= items), "repository_id").join(facts, "repository_id").withColumn("fact", F.when(F.col("row_pos") == 1, F.col("fact"))).withColumn("row_pos", F.col("row_pos") + shift)
        return one.withColumn("start_line", F.lit(0)).withColumn("end_line", F.lit(0)).select(*_item(8, F.col("fact"), V.TIER_DEPENDENCY, rel, 0.6, path="path", kind=F.lit("file"), name="path"))

    times = F.concat(F.col("path"), F.lit(" ("), F.col("n").cast("string"), F.lit(" importers)"))
    a = rows(central, "Files imported most: ", times, F.concat(F.lit("imported by "), F.col("n").cast("string"), F.lit(" files")), CENTRAL_ITEMS, 0)
    b = rows(entry, "Files that import and are never imported: ", F.col("path"), F.lit("entry point"), ENTRY_ITEMS, 100)
    return a.unionByName(b)


def graph_context(questions: DataFrame, g: G.Graph) -> DataFrame:
    """the generators that each question's intents ask for.

    What the graph tells of a name is the same for every question that asks for it, so it is found once a name and then dealt to questions.
    """
    wants = questions.where("wants_graph")
    has = lambda *i: F.arrays_overlap("intents", F.array(*[F.lit(x) for x in i]))
    named = _named(wants)
    names = named.groupBy("repository_id", "asked").agg(F.max(has("callers", "callees") | F.col("is_flow")).alias("calls"), F.max(has("inheritance")).alias("inheritance"))
    # A name stands for the question, and its place, that the generators go by.
    names = materialize(names.withColumn("question_id", F.col("repository_id")).withColumn("name_pos", F.col("asked")), "names")
    hits, links = resolve(names, g, calls=False)
    told = reduce(
        DataFrame.unionByName,
        [definitions(hits), class_structure(links), callers(links.where("calls")), callees(links.where("calls")), inheritance(links.where("inheritance")), callers(links.where("calls"), 9), callees(links.where("calls"), 10)],
    )
    at = lambda *steps: F.col("step").isin(*steps)
    wanted = F.when(at(3), has("callers")).when(at(4), has("callees")).when(at(5), has("inheritance")).when(at(9, 10), F.col("is_flow")).otherwise(True)
    told = told.withColumnsRenamed({"question_id": "repository_id", "name_pos": "asked"}).join(named, ["repository_id", "asked"]).where(wanted).select(*told.columns)
    paths = small(_named(wants, "file_paths"))
    return reduce(
        DataFrame.unionByName,
        [
            told,
            file_dependencies(paths.where(has("importers", "dependencies")), g), file_contents(paths.where(has("file_contents")), g), architecture(wants.where(has("architecture", "entry_point")), g),
        ],
    )


def expansion(hits: DataFrame, g: G.Graph) -> DataFrame:
    """hits(question_id, repository_id, position, entity_type, entity_name) -> neighbours of the first three code hits, found once a name."""
    seeds = hits.where(F.col("entity_type").isin("function", "method", "class")).withColumn("name_pos", F.row_number().over(Window.partitionBy("question_id").orderBy("position"))).where(F.col("name_pos") <= SEEDS)
    label = g.nodes.select("repository_id", "node_id", "node_type", "name", "file_path", "start_line", "end_line")
    both = g.edges.select("repository_id", F.col("src").alias("here"), F.col("dst").alias("node_id"), "rel_type", F.lit("->").alias("arrow")).unionByName(g.edges.select("repository_id", F.col("dst").alias("here"), F.col("src").alias("node_id"), "rel_type", F.lit("<-").alias("arrow")))
    named = label.where(F.col("node_type").isin(*G.LABELS)).select("repository_id", F.col("node_id").alias("here"), F.col("name").alias("entity_name"))
    seeds = seeds.select("question_id", "repository_id", "name_pos", "entity_name")
    here = materialize(named.join(small(seeds.select("repository_id", "entity_name").distinct()), ["repository_id", "entity_name"]), "seeds")
    rows = small(here).join(both, ["repository_id", "here"]).join(label, ["repository_id", "node_id"])
    rows = rows.select("repository_id", "entity_name", "rel_type", "arrow", "node_id", "node_type", "name", "file_path", "start_line", "end_line").distinct()
    place = F.row_number().over(Window.partitionBy("repository_id", "entity_name").orderBy("arrow", "rel_type", "node_id"))
    top = rows.withColumn("row_pos", place).where(F.col("row_pos") <= NEIGHBOURS).join(seeds, ["repository_id", "entity_name"])
    fact = F.concat(F.concat_ws(" ", "entity_name", "arrow", "rel_type", "arrow", "name"), F.when(F.coalesce("file_path", F.lit("")) != "", F.concat(F.lit(" ("), "file_path", F.lit(")"))).otherwise(""))
    return top.select(*_item(20, fact, V.TIER_RELATED, F.concat_ws(" ", "rel_type", "entity_name"), 0.65))


def vector_items(questions: DataFrame, chunks: DataFrame, embed, default_limit: int | None = None) -> DataFrame:
    """V5, V7 for a batch: (question_id, repository_id, position, chunk columns, score, tier, reason) within each question's repository.

    embed: Column -> Column, the vector of a text; chunks hold `embedding`. Questions and chunks of a repository meet in bounded cells.
    """
    limit = F.lit(default_limit) if default_limit else vector_limit(F.col("question_type"))
    asked = questions.select(F.col("question_id").alias("query_id"), "repository_id", embed(F.col("question")).cast("array<double>").alias("__q"), limit.cast("int").alias("__k"))
    asked = materialize(asked.withColumn("k", F.col("__k")), "questions_embedded")  # counted, then read
    stored = chunks.withColumn("__v", F.col("embedding").cast("array<double>")).drop("embedding")
    scored = V.nearest(stored, asked, ["file_path", "start_line", "entity_name"], "repository_id").withColumnRenamed("query_id", "question_id")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "file_path", "start_line", "entity_name"))
    top = scored.withColumn("rank", place).where(F.col("rank") <= F.col("k")).drop("k")
    return V.with_tier(top, "entity_type").withColumnRenamed("rank", "position")


def _as_items(df: DataFrame, order: Column, **given: Column) -> DataFrame:
    have = set(df.columns)
    wanted = ["question_id", "repository_id", "file_path", "entity_type", "entity_name", "start_line", "end_line", "content", "language", "score", "source", "tier", "relationship", "reason"]
    cols = [given.get(c, F.col(c) if c in have else F.lit("")).alias(c) for c in wanted]
    return df.select(*cols, order.alias("__order"))


class Retrieved(NamedTuple):
    """ranked items, distinct facts, and degraded(question_id, retriever, error): which questions a retriever failed for."""

    ranked: DataFrame
    facts: DataFrame
    degraded: DataFrame


#: Failures of one retriever after which the questions that are still open are given up together.
FAILURES = 24
_DEGRADED = "question_id long, retriever string, error string"


def isolated(questions: DataFrame, run: Callable[[DataFrame], DataFrame], name: str) -> tuple[DataFrame | None, DataFrame]:
    """(what `run` gives for the questions it works for, written; the others, as degraded rows).

    A batch that fails is halved by the hash of its questions until those at fault stand alone, so one bad question costs about
    2 log n runs; a retriever that fails whatever it is asked is given up after FAILURES runs. None where nothing worked.
    """
    spark = questions.sparkSession
    failed, done, bad = 0, None, spark.createDataFrame([], _DEGRADED)
    open_ = [(1, 0)]  # (parts, part) of the hash
    place = F.xxhash64("question_id")
    while open_:
        parts, part = open_.pop()
        some = questions.where(F.pmod(place, F.lit(parts)) == part) if parts > 1 else questions
        try:
            got = materialize(run(some), f"{name}_found")
            done = got if done is None else done.unionByName(got)
        except Exception as e:  # whatever a retriever raises, the other one's items are still wanted
            failed += 1
            text = f"{type(e).__name__}: {e}"[:300]
            logging.getLogger(__name__).warning("%s retriever, part %d of %d: %s", name, part, parts, text)
            if failed < FAILURES and some.limit(2).count() > 1:
                open_ += [(2 * parts, part), (2 * parts, part + parts)]
            else:
                bad = bad.unionByName(some.select(F.col("question_id").cast("long").alias("question_id"), F.lit(name).alias("retriever"), F.lit(text).alias("error")))
    return done, bad


def _whole(questions: DataFrame, run: Callable[[DataFrame], DataFrame], name: str) -> tuple[DataFrame, DataFrame]:
    """What `isolated` gives where nothing fails; any failure is raised."""
    return materialize(run(questions), f"{name}_found"), questions.sparkSession.createDataFrame([], _DEGRADED)


def retrieve(questions: DataFrame, chunks: DataFrame, g: G.Graph, files: DataFrame | None = None, embed=None, limit: int = R.CONTEXT_LIMIT, partial: bool = True) -> Retrieved:
    """H1 for questions(question_id, repository_id, question). Each retriever is written by itself: one that fails leaves the other's items.

    partial: if False, a failure is raised, for callers that do not show `degraded`: without it a part looks like the whole.
    """
    from stratagraph.functions.vectors import hashing_embedding
    from stratagraph.sources.repository import read_lines

    # Written once each: both feed several branches, whose plans would multiply.
    asked = materialize(analyse(questions), "asked")
    take = isolated if partial else _whole
    hits, lost = take(asked.where("use_vector"), lambda some: vector_items(some, chunks, embed or hashing_embedding), "vector")

    def from_graph(some: DataFrame) -> DataFrame:
        found = graph_context(some, g)
        if hits is not None:
            found = found.unionByName(expansion(hits.join(small(some.select("question_id")), "question_id", "left_semi"), g))
        return found.join(some.select("question_id", "repository_id"), "question_id")

    found, missing = take(asked.where("wants_graph"), from_graph, "graph")
    order = lambda k, *c: F.struct(F.lit(k).alias("k"), *[F.coalesce(x, F.lit(0)).cast("long").alias(f"o{n}") for n, x in enumerate(c)])
    items = []
    if hits is not None:
        items.append(_as_items(hits, order(0, F.col("position"), F.lit(0), F.lit(0)), source=F.lit("vector")))
    if found is not None:
        graph = _as_items(found.where("file_path <> ''"), order(1, F.col("step"), F.col("name_pos"), F.col("row_pos")), source=F.lit("graph"))
        items.append(graph if files is None else read_lines(graph, files))
    if not items:
        empty = vector_items(asked.limit(0), chunks.limit(0), lambda c: F.array().cast("array<double>"))
        items.append(_as_items(empty, order(0, F.col("position"), F.lit(0), F.lit(0)), source=F.lit("vector")))
    both = reduce(DataFrame.unionByName, items).withColumn("seq", F.row_number().over(Window.partitionBy("question_id").orderBy("__order"))).drop("__order")
    if found is None:
        facts = asked.limit(0).select("question_id", F.lit(1).alias("seq"), F.lit("").alias("fact"))
    else:
        facts = found.where("fact is not null").withColumn("seq", F.row_number().over(Window.partitionBy("question_id").orderBy("step", "name_pos", "row_pos"))).select("question_id", "seq", "fact")
    return Retrieved(R.rank(both.drop("repository_id"), limit), R.distinct_facts(facts), lost.unionByName(missing))


def hybrid(questions: DataFrame, chunks: DataFrame, g: G.Graph, files: DataFrame | None = None, embed=None, limit: int = R.CONTEXT_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(ranked items, distinct facts) of `retrieve`, which raises where a retriever fails."""
    return retrieve(questions, chunks, g, files, embed, limit, partial=False)[:2]


def vector_only(questions: DataFrame, chunks: DataFrame, embed=None, limit: int = R.CONTEXT_LIMIT) -> DataFrame:
    """H2: the baseline, ranked in the same way."""
    from stratagraph.functions.vectors import hashing_embedding

    hits = vector_items(questions, chunks, embed or hashing_embedding, max(limit, 20))
    items = _as_items(hits, F.struct("position"), source=F.lit("vector")).withColumn("seq", F.row_number().over(Window.partitionBy("question_id").orderBy("__order")))
    return R.rank(items.drop("__order", "repository_id"), limit)
