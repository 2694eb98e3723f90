"""Retrieval metrics, aggregation, comparison of systems, failure cases.

retrieved(system, question_id, position, file_path); questions(question_id, category, relevant_files array).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)


def ranked_files(retrieved: DataFrame) -> DataFrame:
    """M0: distinct files at their best place, renumbered from 1."""
    best = retrieved.groupBy("system", "question_id", "file_path").agg(F.min("position").alias("position"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("system", "question_id").orderBy("position", "file_path"))).drop("position")


def question_metrics(retrieved: DataFrame, questions: DataFrame) -> DataFrame:
    """M1-M4 for each system and question: recall at 1, 3, 5 and 10, precision at 5, reciprocal rank, relevant-file rate.

    Every question is scored for every system, also when nothing was retrieved.
    """
    judged = ranked_files(retrieved).join(questions.select("question_id", "relevant_files"), "question_id")
    judged = judged.withColumn("hit", F.array_contains("relevant_files", F.col("file_path"))).drop("relevant_files")
    return judged_metrics(judged, questions.select("question_id", "category", F.size("relevant_files").alias("relevant")), retrieved.select("system").distinct())


def judged_metrics(judged: DataFrame, questions: DataFrame, systems: DataFrame) -> DataFrame:
    """`question_metrics` of judged(system, question_id, place, hit) and questions(question_id, category, relevant), which is the number of relevant files.

    Only what was retrieved is judged, so lists of relevant files, which may be as long as the table, are not made.
    """
    rows = questions.crossJoin(F.broadcast(systems)).join(judged, ["system", "question_id"], "left")  # systems: a handful of names
    total = F.first("relevant")
    hit = F.col("hit")
    within = lambda k: F.count_if(hit & (F.col("place") <= k))
    recall = [F.when(total == 0, 1.0).otherwise(within(k) / total).alias(f"recall_at_{k}") for k in KS]
    shown = F.count_if(F.col("place") <= 5)
    return rows.groupBy("system", "question_id", "category").agg(
        *recall,
        F.when((total == 0) | (shown == 0), 0.0).otherwise(within(5) / shown).alias("precision_at_5"),
        F.coalesce(1.0 / F.min(F.when(hit, F.col("place"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.max(F.when(hit, 1.0).otherwise(0.0)), F.lit(0.0)).alias("relevant_file_rate"),
    )


def _share(hits: Column, wanted: Column) -> Column:
    return F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(hits) / F.size(wanted))


def entity_coverage(found: Column, wanted: Column) -> Column:
    """M5."""
    low = F.transform(found, lambda x: F.lower(x))
    return _share(F.filter(wanted, lambda x: F.array_contains(low, F.lower(x))), wanted)


def mention_coverage(answer: Column, wanted: Column) -> Column:
    """M6."""
    return _share(F.filter(wanted, lambda x: F.lower(answer).contains(F.lower(x))), wanted)


def citation_accuracy(verified: Column, unverified: Column) -> Column:
    """M7."""
    return F.when(verified + unverified == 0, 0.0).otherwise(verified / (verified + unverified))


def citation_coverage(citations: Column, relevant: Column) -> Column:
    """M8."""
    cited = F.transform(citations, lambda c: F.substring_index(c, ":", 1))
    return _share(F.filter(relevant, lambda x: F.array_contains(cited, x)), relevant)


def mean(column: str) -> Column:
    """M9: mean to 4 places, 0 of nothing."""
    return F.round(F.coalesce(F.avg(column), F.lit(0.0)), 4)


def aggregate(results: DataFrame, metrics: list[str]) -> DataFrame:
    """Means by system, and by system and category (category null: all), in one pass over grouping sets."""
    return results.groupingSets([["system"], ["system", "category"]], "system", "category").agg(F.count("*").alias("count"), *[mean(m).alias(m) for m in metrics])


def compare(aggregates: DataFrame, metrics: list[str], baseline: str = "vector", other: str = "hybrid") -> DataFrame:
    """(metric, baseline, other, delta) of the overall rows; no rows unless both systems are there."""
    long = aggregates.where("category is null and system in ('{}', '{}')".format(baseline, other)).unpivot("system", metrics, "metric", "value")
    wide = long.groupBy("metric").pivot("system", [baseline, other]).agg(F.first("value"))
    return wide.where(F.col(baseline).isNotNull() & F.col(other).isNotNull()).withColumn("delta", F.round(F.col(other) - F.col(baseline), 4))


def failure_cases(results: DataFrame, limit: int = 10) -> DataFrame:
    """Questions without a relevant file, or with an unsupported citation; the first `limit` by question and system."""
    bad = F.col("relevant_file_rate") == 0
    if "hallucinated" in results.columns:
        bad = bad | F.col("hallucinated")
    return results.where(bad).orderBy("question_id", "system").limit(limit)


def report(aggregates: DataFrame, comparison: DataFrame) -> str:
    """Markdown tables; both inputs have a row a system, category or metric."""
    def table(df: DataFrame) -> str:
        rows = df.orderBy(*df.columns[:2]).collect()
        head = f"| {' | '.join(df.columns)} |\n|{' --- |' * len(df.columns)}\n"
        return head + "\n".join(f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in rows)

    return f"# Retrieval evaluation\n\n## Means\n\n{table(aggregates)}\n\n## Comparison\n\n{table(comparison)}\n"
