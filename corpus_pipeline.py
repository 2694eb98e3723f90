"""The corpus pipeline: five stages over documents, each reading what the one before it wrote.

Defined results, stage by stage; where a stage's operator defines more, that holds too.
- language_id: null, empty and blank texts, texts without a letter and those strange to every learned language go. Each row is
  decided by its own text, whatever its id, null ones included. Nothing learned: all rows stay.
- exact_dedup: of equal texts the smallest id stays, a null id last; of rows of one id and text one stays.
- near_dedup: of a class the row of the smallest id stays; rows without id stay; an id over several texts is several documents.
- source_mixing: every row stays, some are repeated; a null source is a source.
- bpe_words: a row for each row; null and empty texts have no ids.
Very long texts are taken whole, ties go to the smaller id, repeated rows are decided alike, an empty table gives no rows, and
all stages but the last return the columns of their input, extra ones included, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratagraph.llm.common import documents, materialize
from stratagraph.llm.exact_dedup import drop_exact_copies
from stratagraph.llm.language_id import keep_known_languages
from stratagraph.llm.mixing import mix_sources
from stratagraph.llm.near_dedup import drop_near_copies
from stratagraph.llm.queries import bpe_digests


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay."""
    return keep_known_languages(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return drop_near_copies(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated towards the target mix; none is cut."""
    return mix_sources(docs)


def bpe_words(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts of each row."""
    return bpe_digests(docs, CHUNK_BYTES)


#: Bytes of text of a chunk in bpe_words: here executors still hold what the stages before took.
CHUNK_BYTES = 1 << 23

STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("bpe_words", bpe_words),
]

#: Language filters, signatures and tokens have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
