"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.plans.scratch import shared_dir

from . import common, pii, warc
from .bpe_words import CHUNK_BYTES, encode_texts
from .exact_dedup import exact_dedup
from .fill_in_middle import fill_in_middle, restored
from .language_id import predict_languages, train_filters
from .mixing import mix_plan
from .near_dedup import near_classes
from .quality_rules import quality_rules
from .repair_store import read_token_blocks, write_token_blocks
from .suffix_lm import score_texts
from .toxicity import learn_lexicon, score_toxicity
from .whitening import whitened_components

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(common.documents(spark, sf_dir), common.labels(spark, sf_dir))
    return out.select(
        "doc_id",
        "n_words",
        F.col("n_word_chars").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "rule",
    )


@query
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(common.documents(spark, sf_dir))


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    out = exact_dedup(docs, carry={"text_sha256": F.sha2(F.col("__norm").cast("binary"), 256)})
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op8_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    out = predict_languages(docs, train_filters(docs))
    return out.select("doc_id", (common.fold_of("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def bpe_digests(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    return encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), decode=True, digests=True, chunk_bytes=chunk_bytes)


@query
def op6_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(common.documents(spark, sf_dir))


@query
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(common.documents(spark, sf_dir))


@query
def op7_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = write_token_blocks(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return read_token_blocks(blocks, with_ids=False)


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    out = score_toxicity(docs, learn_lexicon(docs, common.labels(spark, sf_dir)))
    return out.select("doc_id", (common.fold_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query
def op5_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_texts(common.documents(spark, sf_dir))
    return out.select("doc_id", (common.fold_of("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    found = pii.find_spans(docs, pii.fit(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitening of x = floor(1024 c) + 100000 of every embedding entry c."""
    vectors = common.embeddings(spark, sf_dir)
    finite = F.transform("embedding", lambda c: F.when(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.floor(c.cast("double") * 1024) + 100_000))
    squares = lambda m: F.aggregate(
        F.zip_with(F.transform("vector", lambda x: x.cast("long")), F.lit([int(h) + int(w) for h, w in zip(*m.sums)]), lambda x, s: x * m.n - s), F.lit(0).cast("long"), lambda a, d: a + d * d
    )
    return whitened_components(vectors.select("vec_id", finite.alias("x")), "vec_id", "x", 8, {"deviation": squares})


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(common.documents(spark, sf_dir))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    return out.select("doc_id", "n", "form", chars("prefix"), chars("middle"), digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))


ORACLES["op12_fill_in_middle"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, CAST(len(w) AS BIGINT) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""


@query
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as archives of one stream each, normalised, and read back through the sidecars."""
    pages = common.pages(spark, sf_dir)
    streams = warc.write_monolithic(warc.page_records(pages), f"{shared_dir(spark)}/monolithic")
    found = warc.resolved(warc.read_records(warc.normalise(spark, streams)))
    return found.select(F.col("source").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_source").cast("long").alias("refers_to"))


ORACLES["op13_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT html, min(page_id) AS keep FROM p WHERE payload_bytes >= 100 GROUP BY html)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN keep <> page_id THEN keep END AS refers_to FROM p LEFT JOIN g ON g.html = p.html
"""
