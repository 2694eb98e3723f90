"""A caller whose executors hold much already takes smaller chunks; nothing else differs."""

import public_tokenizers

import corpus_pipeline
from stratagraph.llm import bpe_words


def test_small_chunks_give_the_same(spark):
    docs = spark.createDataFrame([(k, f"word{k % 7} and  <|endoftext|> more{k}\n" * (k % 5)) for k in range(60)] + [(60, None)], "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, small = (sorted(map(tuple, bpe_words.encode_texts(docs, path, decode=True, digests=True, chunk_bytes=n).collect())) for n in (bpe_words.CHUNK_BYTES, 200))
    assert len(whole) == 61 and whole == small
    assert corpus_pipeline.CHUNK_BYTES < bpe_words.CHUNK_BYTES
