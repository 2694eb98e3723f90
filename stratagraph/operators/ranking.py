"""Ranking and context assembly (K1-K7, H3), for a batch of questions at once.

items(question_id, file_path, entity_type, entity_name, start_line, end_line, content, language, score, source,
tier, relationship, reason, seq); seq is the emission order within the question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.plans.scratch import materialize, spread

# Weight by tier, boost for both sources, score floor.
TIER_WEIGHTS = [1.0, 0.8, 0.65, 0.5, 0.45, 0.3]
BOTH_BOOST, SCORE_FLOOR = 1.15, 0.01
PER_FILE_CAP, CONTEXT_LIMIT, CONTEXT_CHARS, LEAST_PARTIAL, MAX_FACTS = 4, 12, 24_000, 400, 25
KEY = ["question_id", "file_path", "entity_name", "start_line", "end_line"]


def overlaps(a: str, b: str) -> Column:
    """K2: closed line intervals of one file meet."""
    return (F.col(f"{a}.file_path") == F.col(f"{b}.file_path")) & (F.col(f"{a}.start_line") <= F.col(f"{b}.end_line")) & (F.col(f"{b}.start_line") <= F.col(f"{a}.end_line"))


def merge_relationships(ordered: Column) -> Column:
    """Fold of relationships in order; one that the text so far contains is not added."""
    return F.aggregate(
        ordered, F.lit(""), lambda acc, x: F.when((F.coalesce(x, F.lit("")) == "") | acc.contains(x), acc).when(acc == "", x).otherwise(F.concat(acc, F.lit(", "), x))
    )


def merge_duplicates(items: DataFrame) -> DataFrame:
    """K1: one row a key with the best tier and score, first content and merged relationships; the rest from the first."""
    by_seq = lambda c: F.min_by(c, "seq")
    rel = F.transform(F.array_sort(F.collect_list(F.struct("seq", "relationship"))), lambda x: x["relationship"])
    first_text = F.min_by("content", F.when(F.coalesce("content", F.lit("")) != "", F.col("seq")))
    return items.groupBy(*KEY).agg(
        by_seq("entity_type").alias("entity_type"), F.coalesce(first_text, F.lit("")).alias("content"), by_seq("language").alias("language"), F.max("score").alias("score"),
        F.when(F.min("source") == F.max("source"), F.min("source")).otherwise("both").alias("source"),
        F.min("tier").alias("tier"), merge_relationships(rel).alias("relationship"), by_seq("reason").alias("reason"), F.min("seq").alias("seq"),
    )


def final_score() -> Column:
    weight = F.element_at(F.array(*[F.lit(w) for w in TIER_WEIGHTS]), F.least(F.col("tier"), F.lit(5)) + 1)
    boost = F.when(F.col("source") == "both", BOTH_BOOST).otherwise(1.0)
    return weight * boost * F.greatest(F.col("score"), F.lit(SCORE_FLOOR))


def ordered(merged: DataFrame) -> DataFrame:
    """Merged items with `rnk`, the place by weighted score, tier, file and emission."""
    order = Window.partitionBy("question_id").orderBy(F.desc("weighted"), "tier", "file_path", "seq")
    return merged.withColumn("weighted", F.round(final_score(), 9)).withColumn("rnk", F.row_number().over(order))


def remove_contained(ranked: DataFrame) -> DataFrame:
    """K3: without items whose lines lie inside a better-ranked item of the same file.

    As containment is transitive, better-ranked items need not be kept ones themselves. No two items are joined: the places within
    a file are halved again and again, and at each level the items of a left half are held against those of its right half by one
    running maximum of their ends in the order of their starts. Any two items are on two sides at one level, so n items cost
    n log n comparisons in each of log n sorts, all of them after the one shuffle by question and file, in tasks of bounded size.
    """
    ranked = materialize(ranked, "ordered")
    per_file = ["question_id", "file_path"]
    most, rows = ranked.groupBy(*per_file).count().agg(F.max("count"), F.sum("count")).first()
    most = most or 0
    out = spread(ranked, rows or 0, *per_file).withColumn("__r", F.row_number().over(Window.partitionBy(*per_file).orderBy("rnk")) - 1).withColumn("__inside", F.lit(False))
    first, last = F.least("start_line", "end_line"), F.greatest("start_line", "end_line")
    for level in range((most - 1).bit_length() if most else 0):
        right = F.shiftright("__r", level) % 2 == 1
        upto = Window.partitionBy(*per_file, F.shiftright("__r", level + 1)).orderBy(F.when(right, first).otherwise(F.col("start_line")), right).rowsBetween(Window.unboundedPreceding, 0)
        reach = F.max(F.when(~right & F.col("start_line").isNotNull(), F.col("end_line"))).over(upto)
        out = out.withColumn("__inside", F.col("__inside") | F.coalesce(right & (reach >= last), F.lit(False)))
    return out.where("not __inside").drop("__r", "__inside")


def rank(items: DataFrame, limit: int | Column = CONTEXT_LIMIT, per_file_cap: int = PER_FILE_CAP) -> DataFrame:
    """K4: the best `limit` items a question with `position`; items over the file cap only fill what is left."""
    kept = remove_contained(ordered(merge_duplicates(items)))
    in_file = Window.partitionBy("question_id", "file_path").orderBy("rnk")
    final = Window.partitionBy("question_id").orderBy("over", "rnk")
    capped = kept.withColumn("over", (F.row_number().over(in_file) > per_file_cap).cast("int"))
    return capped.withColumn("position", F.row_number().over(final)).where(F.col("position") <= limit).drop("over", "rnk")


def citation(file_path: Column, start: Column, end: Column) -> Column:
    """K6: the path alone for items without lines."""
    return F.when(start <= 0, file_path).otherwise(F.format_string("%s:%d-%d", file_path, start, end))


def cited_files(ranked: DataFrame) -> DataFrame:
    """K5: distinct files a question by first place."""
    files = F.transform(F.array_sort(F.collect_list(F.struct("position", "file_path"))), lambda x: x["file_path"])
    return ranked.groupBy("question_id").agg(F.array_distinct(files).alias("files"))


def distinct_facts(facts: DataFrame, limit: int = MAX_FACTS) -> DataFrame:
    """H3: facts(question_id, seq, fact) -> the first `limit` distinct ones in order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "fact"))), lambda x: x["fact"])
    return facts.groupBy("question_id").agg(F.slice(F.array_distinct(texts), 1, limit).alias("facts"))


def context_blocks(ranked: DataFrame, facts: DataFrame | None = None, budget: int = CONTEXT_CHARS) -> DataFrame:
    """K7: (question_id, position, block) of the evidence that fits the budget, the facts' block counted first.

    The first block that overflows is cut if at least 400 characters remain, and nothing follows it.
    """
    head = F.concat(F.format_string("[%d] %s %s\nPlace: ", "position", "entity_type", "entity_name"), citation(F.col("file_path"), F.col("start_line"), F.col("end_line")))
    head = F.concat(head, F.when(F.coalesce("relationship", F.lit("")) != "", F.concat(F.lit("\nLink: "), "relationship")).otherwise(""))
    body = F.trim(F.coalesce("content", F.lit("")), F.lit(" \t\n\r\x0b\x0c"))
    block = F.when(body == "", head).otherwise(F.concat(head, F.lit("\n```"), F.coalesce("language", F.lit("")), F.lit("\n"), body, F.lit("\n```")))
    rows = ranked.withColumn("block", block)
    if facts is None:
        rows = rows.withColumn("__facts", F.lit(0))
    else:
        size = facts.select("question_id", F.when(F.size("facts") > 0, F.length(facts_block("facts"))).otherwise(0).alias("__facts"))
        rows = rows.join(size, "question_id", "left").withColumn("__facts", F.coalesce("__facts", F.lit(0)))
    before = Window.partitionBy("question_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    left = rows.withColumn("__left", F.lit(budget) - F.col("__facts") - F.coalesce(F.sum(F.length("block")).over(before), F.lit(0)))
    fits = F.length("block") <= F.col("__left")
    cut = F.concat(F.expr("substring(block, 1, cast(__left as int))"), F.lit("\n... (cut)\n```"))
    return left.where(fits | (F.col("__left") >= LEAST_PARTIAL)).select("question_id", "position", F.when(fits, F.col("block")).otherwise(cut).alias("block"))


def facts_block(facts: str) -> Column:
    return F.concat(F.lit("Known from the graph:\n"), F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f)), "\n"))


def context_text(ranked: DataFrame, facts: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """(question_id, context) with facts and evidence joined."""
    blocks = context_blocks(ranked, facts, budget).groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "block"))), lambda x: x["block"]), "\n\n").alias("code"))
    both = facts.select("question_id", F.when(F.size("facts") > 0, facts_block("facts")).alias("head")).join(blocks, "question_id", "full")
    text = F.concat_ws("\n\n", "head", F.when(F.col("code").isNotNull(), F.concat(F.lit("Code that was found:\n\n"), "code")))
    return both.select("question_id", F.when(text == "", "Nothing was found.").otherwise(text).alias("context"))
