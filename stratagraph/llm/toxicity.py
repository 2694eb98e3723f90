"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding: lower case, compatibility forms taken apart, accents dropped, look-alike letters of other alphabets
and digits or signs that stand for letters replaced. The lexicon is learned: word beginnings and whole
words whose folded form is met in toxic documents far more often than in others, weighted by their log odds.
Phrases around an entry that only harmless documents hold become exceptions: longer patterns of weight 0,
which the leftmost-longest match prefers to the entry inside them. The weights found in a text, divided by its
length, go through a logistic curve to a score.

Bounds: the lexicon, the exceptions and the curve are fitted on at most about TRAIN_ROWS labelled rows, chosen by
a hash of the id. Every entry and exception that passes the tests is kept; that sample bounds their number. Every whole text
is scored, however long.

Defined results
- Null and empty texts: the score of a text without any match. No labels, or labels of one kind: score 0.5 less
  a trifle for all (predicted 0) or, if all are toxic, the same (there is nothing to learn from).
- Several labels for one id: their mean, from 0.5 on toxic. Repeated rows are each scored.
- Ties: of matches that begin at one place the longest counts; a score of exactly 0.5 is predicted toxic.
- Empty table: no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bound_batches, fold_of, materialize, text_of
from .word_cache import text_runs

TRAIN_ROWS = 20_000
#: Word beginnings of these lengths may become entries.
STEMS = (4, 5, 6, 8)
#: Least lower end of an entry's log odds, at Z standard errors.
LEAST_WEIGHT, Z = 1.3, 1.64

# Digits, signs and letters of other alphabets that are read as Latin letters.
_LOOK_ALIKE = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i",
    "а": "a", "в": "b", "е": "e", "з": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d",
}
_SIGNS = re.compile(r"[@$!]+(?![^\W_])")
_ACCENTS = re.compile("[̀-ͯ​-‏⁠﻿­]+")
_TABLE = {i: " " for i in range(128) if not chr(i).isalnum()} | {ord(k): v for k, v in _LOOK_ALIKE.items()}


def fold_words(text: str) -> list[str]:
    """Folded words of a text."""
    text = text.lower()
    if "!" in text or "@" in text or "$" in text:
        text = _SIGNS.sub(" ", text)  # a sign stands for a letter only in front of one
    if not text.isascii():
        text = _ACCENTS.sub("", unicodedata.normalize("NFKD", text))
    return text.translate(_TABLE).split()


def _spaced(words: list[str]) -> str:
    return f" {'  '.join(words)} "


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]  # pattern -> weight, 0 for an exception
    slope: float
    bias: float

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for p, w in self.weights.items():
            found.add_word(p, w)
        if len(found):
            found.make_automaton()
        return found


def _raw(words: list[str], automaton: ahocorasick.Automaton) -> float:
    """Weight of the matches for each thousand words, of a text taken to be at least 20 words long."""
    total = sum(w for _, w in automaton.iter_long(_spaced(words))) if len(automaton) else 0.0
    return math.log1p(1000 * total / max(20, len(words)))


def _log_odds(p: int, n: int, P: int, N: int) -> tuple[float, float]:
    w = math.log((p + 0.5) / (P + 1)) - math.log((n + 0.5) / (N + 1))
    return w, w - Z * math.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton's method with a small ridge on the slope."""
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((y - p) * x).sum() - 0.01 * a, (y - p).sum()])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -5, 5)), b + float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-8:
            break
    return a, b


def _patterns(words: set[str]) -> set[str]:
    out = {f" {w} " for w in words}
    for k in STEMS:
        out.update(f" {w[:k]}" for w in words if len(w) >= k)
    return out


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pos: Counter = Counter()
    neg: Counter = Counter()

    def rows() -> pa.RecordBatch:
        keys = list(pos.keys() | neg.keys())
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], names=["pattern", "p", "n"])
        pos.clear()
        neg.clear()
        return out

    for batch in batches:
        toxic = batch.column(1).to_pylist()
        for first, texts in text_runs(batch.column(0)):
            for k, t in enumerate(texts, first):
                (pos if toxic[k] else neg).update(_patterns(set(fold_words(t))))
            if len(pos) + len(neg) > 1_000_000:
                yield rows()
    yield rows()


def learn_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, train_rows: int = TRAIN_ROWS) -> Lexicon:
    """Fit on labelled rows whose fold (crc32 of the id as text, modulo folds) is not 0."""
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id is not null and label is not null").where(fold_of("id", folds) != 0)
    lab = lab.groupBy("id").agg((F.avg("label") >= 0.5).alias("toxic"))
    n = lab.count()
    share = min(1.0, train_rows / max(1, n))
    if share < 1:
        lab = lab.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    lab = materialize(lab, "toxic_labels")
    small = F.broadcast(lab) if lab.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lab
    sample = materialize(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(small, "id").select("text", "toxic"), "toxic_sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    P, N = sizes.get(True, 0), sizes.get(False, 0)
    if not P or not N:
        return Lexicon({}, 0.0, -1e-6)
    least = max(3, round(0.002 * P))
    lift = F.log((F.col("p") + 0.5) / (P + 1)) - F.log((F.col("n") + 0.5) / (N + 1))
    low = lift - Z * F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
    counts = sample.mapInArrow(_tally, "pattern string, p long, n long").groupBy("pattern").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    rows = counts.where((F.col("p") >= least) & (low >= LEAST_WEIGHT)).orderBy("pattern").collect()  # as many as the bounded sample holds
    entries: dict[str, float] = {}
    odds = {r["pattern"]: _log_odds(r["p"], r["n"], P, N) for r in rows}
    for pattern in sorted(odds, key=len):
        w, lower = odds[pattern]
        shorter = [odds[pattern[:k]] for k in range(2, len(pattern)) if pattern[:k] in odds]
        # A longer form is kept where it tells more than the beginning it shares.
        if all(lower > s[1] + 0.5 for s in shorter):
            entries[pattern] = w
    entries |= {e: 0.0 for e in _learn_exceptions(sample, entries)}
    scored = sample.mapInArrow(_scorer(docs, Lexicon(entries, 0.0, 0.0)), "x double, toxic boolean").toArrow()
    x, y = scored.column("x").to_numpy(), scored.column("toxic").to_numpy(zero_copy_only=False).astype(float)
    slope, bias = _fit(x, y)
    return Lexicon(entries, max(0.0, slope), bias)


def _scorer(docs: DataFrame, lexicon: Lexicon):
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for batch in batches:
            for first, texts in text_runs(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([_raw(fold_words(t), automaton) for t in texts], pa.float64()), batch.column(1).slice(first, len(texts))], names=["x", "toxic"])

    return score


def _learn_exceptions(sample: DataFrame, entries: dict[str, float], least: int = 3) -> list[str]:
    """Two-word phrases with a match in them that harmless documents hold `least` times and toxic ones never."""
    if not entries:
        return []
    shared = sample.sparkSession.sparkContext.broadcast(Lexicon(entries, 0.0, 0.0))

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for batch in batches:
            out: list[tuple[str, bool]] = []
            toxic = batch.column(1).to_pylist()
            for first, texts in text_runs(batch.column(0)):
                for k, t in enumerate(texts, first):
                    words = fold_words(t)
                    spaced = _spaced(words)
                    ends = [e for e, _ in automaton.iter_long(spaced)]
                    if not ends:
                        continue
                    starts = np.cumsum([0, *(len(w) + 2 for w in words)])
                    for e in ends:
                        i = int(np.searchsorted(starts, e, side="right")) - 1
                        out += [(f" {words[a]}  {words[a + 1]} ", toxic[k]) for a in (i - 1, i) if 0 <= a < len(words) - 1]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.bool_())], names=["phrase", "toxic"])

    counts = sample.mapInArrow(phrases, "phrase string, toxic boolean").groupBy("phrase").agg(F.count_if(~F.col("toxic")).alias("n"), F.count_if("toxic").alias("p"))
    return [r["phrase"] for r in counts.where((F.col("n") >= least) & (F.col("p") == 0)).orderBy("phrase").collect()]


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score (0 to 1) and predicted of every row."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        automaton = lex.automaton()
        for batch in batches:
            for first, texts in text_runs(batch.column(1)):
                x = np.array([_raw(fold_words(t), automaton) for t in texts])
                s = 1 / (1 + np.exp(-np.clip(lex.slope * x + lex.bias, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    base = docs.select(F.col(id_col), text_of(text_col).alias("__text"))
    return base.mapInArrow(score, f"`{id_col}` {dict(base.dtypes)[id_col]}, score double, predicted int")
