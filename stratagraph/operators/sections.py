"""Markdown sections (P15), by windows over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.functions.paths import base_name
from stratagraph.sources.repository import lines

LEAST_SECTION = 40


def sections(files: DataFrame, least: int = LEAST_SECTION) -> DataFrame:
    """(repository_id, file_path, entity_name, start_line, end_line, source_code) of each section of at least `least` characters.

    A heading is a line of one to six # and text, outside fences. What stands before the first is the intro; a file
    without headings is one section. All windows share one partitioning by file.
    """
    rows = files.select("repository_id", "file_path", F.posexplode(lines(F.col("text"))).alias("__i", "line"))
    by_file = Window.partitionBy("repository_id", "file_path").orderBy("__i")
    whole = Window.partitionBy("repository_id", "file_path")
    fence = F.col("line").rlike(r"^\s*```").cast("int")
    heading = F.regexp_extract("line", r"^#{1,6}\s+(.*\S)\s*$", 1)
    marked = rows.withColumn("__fence", fence).withColumn("__open", F.sum("__fence").over(by_file) % 2)
    marked = marked.withColumn("__title", F.when((F.col("__fence") == 0) & (F.col("__open") == 0) & (heading != ""), heading))
    marked = marked.withColumn("__section", F.count("__title").over(by_file)).withColumn("__all", F.count("__title").over(whole))
    name = base_name(F.col("file_path"))
    title = F.coalesce(F.max("__title"), F.when(F.max("__all") == 0, F.first(name)).otherwise(F.concat(F.first(name), F.lit(" (intro)"))))
    text = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", "line"))), lambda x: x["line"]), "\n"), F.lit(" \t\n\r\x0b\x0c"))
    found = marked.groupBy("repository_id", "file_path", "__section").agg(title.alias("entity_name"), (F.min("__i") + 1).alias("start_line"), (F.max("__i") + 1).alias("end_line"), text.alias("source_code"))
    return found.where(F.length("source_code") >= least).drop("__section")
