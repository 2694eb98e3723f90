"""Citations: extraction, verification, stripping, appending; extractive answers."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.plans.scratch import materialize

# How an answer names a place, and how far from a retrieved range its lines may be.
CITATION = r"`?([\w./\-]+\.[A-Za-z0-9]+):(\d+)(?:\s*-\s*(\d+))?`?"
TOLERANCE = 5
UNVERIFIED = " (lines not confirmed)"
SOURCES = "Evidence found for this question:"
MAX_SOURCES = 6
MAX_LOCATIONS = 10
#: Lines of a file that one task sweeps; the largest line number that a column holds.
SWEPT_LINES, LAST_LINE = 4096, 2**31 - 1


def _line(digits: Column) -> Column:
    """A line number as cited; one of more digits than a column holds is the largest."""
    return F.coalesce(digits.try_cast("int"), F.lit(LAST_LINE))


def extract(answers: DataFrame) -> DataFrame:
    """answers(question_id, answer) -> (question_id, seq, file_path, start_line, end_line); a missing end is the start."""
    part = lambda g: F.regexp_extract_all("answer", F.lit(CITATION), F.lit(g))
    found = answers.select("question_id", F.posexplode(F.arrays_zip(part(1).alias("p"), part(2).alias("s"), part(3).alias("e"))).alias("seq", "c"))
    start = _line(F.col("c.s"))
    return found.select("question_id", "seq", F.col("c.p").alias("file_path"), start.alias("start_line"), F.when(F.col("c.e") == "", start).otherwise(_line(F.col("c.e"))).alias("end_line"))


def verify(citations: DataFrame, retrieved: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Distinct citations with `verified`: the file was retrieved and the lines meet a retrieved range within the tolerance.

    A sweep in place of pairs: of the ranges that begin by a citation's end, the one that reaches furthest decides. A running maximum is
    taken in stretches of SWEPT_LINES lines, and what earlier stretches reach is carried over, so a file that is cited and retrieved
    a great many times is many tasks, and work grows with the rows and not with their product. Null keys and null lines meet nothing.
    """
    keys, lines = ["question_id", "file_path"], [F.col(c).cast("long") for c in ("start_line", "end_line")]
    one = citations.groupBy(*keys, "start_line", "end_line").agg(F.min("seq").alias("seq"))
    known = retrieved.where(" and ".join(f"{c} is not null" for c in (*keys, "start_line", "end_line")))
    ranges = known.groupBy(*keys, (lines[0] - tolerance).alias("__at")).agg(F.max(lines[1]).alias("__reach"))
    points = one.select("*", lines[1].alias("__at"), F.lit(True).alias("__cited")).unionByName(ranges, allowMissingColumns=True).withColumn("__part", F.floor(F.col("__at") / SWEPT_LINES))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = points.groupBy(*keys, "__part").agg(F.max("__reach").alias("__reach")).select(*keys, "__part", F.max("__reach").over(before).alias("__carried"))
    upto = Window.partitionBy(*keys, "__part").orderBy("__at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    swept = points.withColumn("__far", F.max("__reach").over(upto)).where("__cited").join(parts, [*keys, "__part"], "left")
    return swept.select(*one.columns, F.coalesce(F.greatest("__far", "__carried") + tolerance >= lines[0], F.lit(False)).alias("verified"))


def strip_unverified(answers: DataFrame, verified: DataFrame) -> DataFrame:
    """Answers with each unsupported reference replaced by its path and a marker.

    One pass over the references as `extract` finds them, so a reference is replaced whole or not at all.
    """
    bad = verified.where("not verified").groupBy("question_id").agg(F.collect_set(F.struct("file_path", "start_line", "end_line")).alias("bad"))
    part = lambda g: F.regexp_extract_all("answer", F.lit(CITATION), F.lit(g))

    def shown(c: Column) -> Column:
        start = _line(c["s"])
        key = F.struct(c["p"].alias("file_path"), start.alias("start_line"), F.when(c["e"] == "", start).otherwise(_line(c["e"])).alias("end_line"))
        return F.when(F.array_contains("bad", key), F.concat(c["p"], F.lit(UNVERIFIED))).otherwise(c["t"])

    found = F.transform(F.arrays_zip(part(0).alias("t"), part(1).alias("p"), part(2).alias("s"), part(3).alias("e")), shown)
    between = F.split("answer", CITATION, -1)
    text = F.array_join(F.flatten(F.zip_with(between, found, lambda x, y: F.array(x, F.coalesce(y, F.lit(""))))), "")
    return answers.join(bad, "question_id", "left").select("question_id", F.when(F.col("bad").isNull(), F.col("answer")).otherwise(text).alias("answer"))


def append_sources(answers: DataFrame, ranked: DataFrame, limit: int = MAX_SOURCES) -> DataFrame:
    """Answers followed by the first located items; unchanged where there is none."""
    located = ranked.where("file_path <> '' and start_line > 0").withColumn("__n", F.row_number().over(Window.partitionBy("question_id").orderBy("position"))).where(F.col("__n") <= limit)
    lines = located.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", F.format_string("- %s:%d-%d", "file_path", "start_line", "end_line").alias("t")))), lambda x: x["t"]), "\n").alias("lines"))
    text = F.concat(F.rtrim(F.col("answer")), F.lit(f"\n\n{SOURCES}\n"), F.col("lines"))
    return answers.join(lines, "question_id", "left").select("question_id", F.when(F.col("lines").isNull(), F.col("answer")).otherwise(text).alias("answer"))


def extractive_answers(contexts: DataFrame, limit: int = MAX_LOCATIONS) -> DataFrame:
    """contexts(question_id, context) -> the distinct locations named in them, or an abstention."""
    found = F.slice(F.array_distinct(F.regexp_extract_all("context", F.lit(r"Place:\s*(\S+:\d+-\d+)"), F.lit(1))), 1, limit)
    listed = F.concat(F.lit("No language model is set up. Locations that matched the question:\n"), F.array_join(F.transform("__l", lambda x: F.concat(F.lit("- "), x)), "\n"))
    return contexts.withColumn("__l", found).select("question_id", F.when(F.size("__l") == 0, "There is not enough evidence in the index to answer this.").otherwise(listed).alias("answer"), (F.size("__l") == 0).alias("abstained"))


def answers_for(contexts: DataFrame, ranked: DataFrame, provider=extractive_answers) -> DataFrame:
    """Generate, verify, strip, and append sources where nothing was verified.

    provider: DataFrame(question_id, context) -> DataFrame(question_id, answer, abstained). Its answers are written before
    they are read, so that one that fails, be it while it runs, is replaced by the extractive one. Returns (question_id, answer, verified, unverified, grounded, abstained).
    """
    try:
        raw = materialize(provider(contexts).select("question_id", "answer", "abstained"), "answers")
    except Exception as e:  # a provider that fails must not fail the batch
        logging.getLogger(__name__).warning("the provider of answers failed, extractive answers stand in: %s: %s", type(e).__name__, str(e)[:300])
        raw = materialize(extractive_answers(contexts), "answers")
    judged = materialize(verify(extract(raw), ranked), "judged")
    counts = judged.groupBy("question_id").agg(F.count_if(F.col("verified")).alias("verified"), F.count_if(~F.col("verified")).alias("unverified"))
    clean = strip_unverified(raw, judged)
    listed = append_sources(clean, ranked).withColumnRenamed("answer", "listed")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = clean.join(listed, "question_id").join(counts, "question_id", "left").join(raw.select("question_id", "abstained"), "question_id")
    bare = (zero(F.col("verified")) == 0) & ~F.col("abstained")
    return out.select("question_id", F.when(bare, F.col("listed")).otherwise(F.col("answer")).alias("answer"), zero(F.col("verified")).alias("verified"), zero(F.col("unverified")).alias("unverified"), (zero(F.col("unverified")) == 0).alias("grounded"), "abstained")
