"""Language identification by bit-sliced Bloom filters over letter n-grams.

One table of slots holds a bit for each language; a gram's languages are the AND of the
slots its hashes name, so one lookup answers for all languages at once. A text's grams are
counted per language, each share is corrected by that language's false-positive rate
((share - fp) / (1 - fp)), and the largest decides.

Grams are four bytes of the lower-cased UTF-8 text, letters inside, a letter or a boundary
at each end. A gram enters a language's filter if it was seen there twice and its rate is at
least RATIO of its best rate in any language.

Bounds: the filters are fitted on about TRAIN_ROWS labelled rows at most, chosen by a hash of the id
from all of them, and on about LANGUAGE_ROWS of each language that has as many, however rare it is; the table has a fixed number of slots; counts stay in Spark and only the slots come
to the driver. Prediction covers every whole text.

Defined results
- Null text, or no letter: `und`, score 0. Ties: the first language by name.
- Letters but no known gram: the language with most training rows, score 0.
- No labelled rows: `und` for all. Empty table: no rows. Extra columns are ignored.
- Repeated rows are each answered; rows with null lang teach nothing. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import bound_batches, fold_of, text_of

SLOTS_LOG2 = 20
HASHES = 3
RATIO = 0.2
TRAIN_ROWS = 20_000
LANGUAGE_ROWS = 500
UNDETERMINED = "und"

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True
_FOLDED = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)
_MULTIPLIERS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]


@dataclass(frozen=True)
class LanguageFilters:
    languages: tuple[str, ...]
    slots: np.ndarray  # (slots, words of 64 languages)
    false_positive: np.ndarray
    likeliest: int


def _grams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, grams, bounds of the rows' grams); a boundary surrounds each text."""
    lower = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    space = pa.scalar(" ", pa.large_string())
    for i, j, data, offsets in S.text_slices(pc.binary_join_element_wise(space, lower, space, pa.scalar("", pa.large_string()))):
        b = _FOLDED[data]
        if len(b) < 4:
            yield i, j, np.zeros(0, np.uint32), np.zeros(j - i + 1, np.int64)
            continue
        letter = _LETTER[data]
        ok = letter[1:-2] & letter[2:-1]
        ends = np.repeat(offsets[1:], np.diff(offsets))[: len(ok)]
        at = np.flatnonzero(ok & (np.arange(len(ok)) + 4 <= ends))
        w = b.astype(np.uint32)
        yield i, j, w[at] | w[at + 1] << np.uint32(8) | w[at + 2] << np.uint32(16) | w[at + 3] << np.uint32(24), np.searchsorted(at, offsets)


def _slots_of(grams: np.ndarray) -> list[np.ndarray]:
    out = []
    for m in _MULTIPLIERS[:HASHES]:
        h = (grams ^ (grams >> np.uint32(15))) * m
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        out.append(h >> np.uint32(32 - SLOTS_LOG2))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in S.small_batches(batches):
        langs = batch.column(0).to_pylist()
        for i, j, grams, bounds in _grams(batch.column(1)):
            by: dict[str, list[np.ndarray]] = {}
            for r in range(i, j):
                by.setdefault(langs[r], []).append(grams[bounds[r - i] : bounds[r - i + 1]])
            for lang, parts in sorted(by.items()):
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = batch.column("gram").to_numpy().astype(np.uint32)
        slots = np.concatenate(_slots_of(grams)) if len(grams) else np.zeros(0, np.uint32)
        lang = np.tile(batch.column("code").to_numpy(), HASHES)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(lang // 64), pa.array(np.left_shift(np.int64(1), lang % 64))], names=["slot", "word", "bits"])


def train_filters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, train_rows: int = TRAIN_ROWS) -> LanguageFilters:
    """Fit on rows whose fold (crc32 of the id as text, modulo folds) is not 0."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null").where(fold_of("id", folds) != 0)
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes))
    slots = np.zeros((1 << SLOTS_LOG2, max(1, -(-len(languages) // 64))), np.uint64)
    if languages:
        share = min(1.0, train_rows / sum(sizes.values()))
        if share < 1:
            upto = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, max(share, LANGUAGE_ROWS / n)) * (1 << 30)))])
            known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < upto[F.col("lang")])
        counts = known.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        code = F.create_map(*[F.lit(x) for k, v in enumerate(languages) for x in (v, k)])
        totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
        rates = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
        best = rates.groupBy("gram").agg(F.max("rate").alias("best"))
        kept = rates.join(best, "gram").where((F.col("n") >= 2) & (F.col("rate") >= RATIO * F.col("best"))).select("gram", code[F.col("lang")].cast("long").alias("code"))
        rows = kept.mapInArrow(_place, "slot long, word long, bits long").groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
        slots[rows.column("slot").to_numpy(), rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    fill = np.array([np.count_nonzero(slots[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)) for k in range(len(languages))]) / len(slots)
    return LanguageFilters(languages, slots, fill**HASHES, max(range(len(languages)), key=lambda k: sizes[languages[k]], default=0))


def _scores(grams: np.ndarray, bounds: np.ndarray, f: LanguageFilters) -> np.ndarray:
    """Corrected share of each row's grams for each language."""
    total = np.maximum(np.diff(bounds), 1)
    out = np.zeros((len(bounds) - 1, len(f.languages)))
    a, b, *rest = _slots_of(grams)
    for word in range(f.slots.shape[1]):
        table = f.slots[:, word]
        if len(f.languages) <= 8:
            table = table.astype(np.uint8)
        found = table[a] & table[b]
        for c in rest:
            found &= table[c]
        for k in range(64 * word, min(64 * word + 64, len(f.languages))):
            hit = found >> found.dtype.type(k % 64) & found.dtype.type(1)
            upto = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
            share = (upto[bounds[1:]] - upto[bounds[:-1]]) / total
            out[:, k] = np.clip((share - f.false_positive[k]) / (1 - f.false_positive[k] + 1e-12), 0, 1)
    return out


def _predicted(texts: pa.Array, f: LanguageFilters) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, number of the language, score); the number behind the last language is undetermined."""
    for i, j, grams, bounds in _grams(texts):
        if f.languages:
            s = _scores(grams, bounds, f)
            top = s.argmax(axis=1)
            score = s[np.arange(len(s)), top]
            top = np.where(score > 0, top, f.likeliest)
        else:
            top, score = np.zeros(j - i, np.int64), np.zeros(j - i)
        part = texts.slice(i, j - i)
        ascii_letter = pc.fill_null(pc.match_substring_regex(part, "[A-Za-z]"), False).to_numpy(zero_copy_only=False)
        for r in np.flatnonzero(~ascii_letter):
            if not any(c.isalpha() for c in part[int(r)].as_py() or ""):
                top[r], score[r] = len(f.languages), 0.0
        yield i, j, top, score


def predict_languages(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred and score for every row."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, UNDETERMINED], dtype=object)
        for batch in S.small_batches(batches):
            for i, j, top, score in _predicted(batch.column(1), shared.value):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names[top], pa.string()), pa.array(score)], names=[id_col, "lang_pred", "score"])

    base = docs.select(F.col(id_col), text_of(text_col).alias("__text"))
    return base.mapInArrow(predict, f"`{id_col}` {dict(base.dtypes)[id_col]}, lang_pred string, score double")


#: Below this share of known grams a document is in none of the learned languages.
MIN_SCORE = 0.2


def keep_known_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows in a learned language, with all their columns; rows without a letter, or strange to all languages, go.

    Each row is decided by its own text, whatever its id, and does not leave its task. Nothing learned: all rows stay.
    """
    filters = train_filters(docs, id_col, text_col, lang_col)
    if not filters.languages:
        return docs
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.small_batches(batches):
            texts = pc.fill_null(batch.column(batch.schema.get_field_index(text_col)), "")
            stays = np.zeros(batch.num_rows, bool)
            for i, j, top, score in _predicted(texts, shared.value):
                stays[i:j] = (top < len(shared.value.languages)) & (score >= min_score)
            yield batch.filter(pa.array(stays))

    return docs.mapInArrow(keep, docs.schema)
