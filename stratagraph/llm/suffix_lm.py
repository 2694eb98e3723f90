"""Language model scoring by a probabilistic suffix tree over the symbols of a text.

A text is its words (ASCII letters lower-cased), each followed by one separator, then one end symbol;
symbols are bytes. The tree's states are contexts of 0 to DEPTH symbols. A context is retained if its
next-symbol distribution differs from its parent's (the context without its oldest symbol) by a divergence
whose total, count x KL in bits, exceeds the cost of describing it; ancestors of retained contexts are
retained too. A state's distribution is smoothed with its parent's by its number of kinds k of next
symbols (Witten-Bell): (count + k x parent) / (total + k), down to a uniform one over 257 symbols. Each symbol is scored at the longest
retained suffix of what stands before it. As every word sequence spells one symbol string, the sum of
the symbols' log10 probabilities is the text's.

The base is an add-0.1 unigram over words. Counts of words and of symbol runs, and the tree, cover all training
texts and stay in Spark; every context that passes the test is kept, so the tree grows with the text (up to what DEPTH
symbols can spell). Words are counted and joined as their own bytes (a word of over LONGEST_WORD bytes as a 256-bit
digest), runs as the integers they spell, so no two are taken for one another. What is broadcast has fixed bounds: the
ENTRIES tree entries of the most frequent states, HOT_WORDS word counts, and a bitmap of the states that are not broadcast. Words
beyond those, and runs that may end in such a state, are joined by a shuffle; a bit set by accident only costs a lookup.

Defined results
- Null and empty texts: one token (the end). Empty training set: base and score from uniform
  distributions (N = 0, V = 0). Very long texts are scored whole. A null id counts as the empty text in the fold.
- Repeated rows are each scored. Empty table: no rows. Extra columns are ignored, whatever their names.
- Ties in a count: states or words of equal counts are broadcast together or not at all; scores do not depend on it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import bound_batches, fold_of, materialize, text_of
from .shingles import mix
from .word_cache import DistinctUnits, strung

DEPTH = 6
ADD = 0.1
#: A context is looked at from this many occurrences on.
LEAST = 8
#: Bits that describing one next symbol costs, times log2 of the context's count.
COST = 0.25
#: Tree entries that are broadcast (80 MB); the others are joined.
ENTRIES = 4_000_000
#: Bits of the bitmap of states that are not broadcast (8 MB).
COLD_BITS = 26
HOT_WORDS = 500_000
LONGEST_WORD = 64
#: Distinct words and runs that a task holds before it passes them on, and symbols that it sorts at once.
HELD_WORDS, HELD_RUNS, SORTED = 1_000_000, 3_000_000, 1_000_000
#: Distinct runs besides those merged already that a task holds before it merges them.
UNMERGED = 1_000_000
#: Words besides the broadcast ones that a worker numbers before it forgets them.
NUMBERED = 500_000
#: Slots of a worker's memory of scored runs (25 MB).
CACHE_BITS = 21

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_END, _SPACE = 0xFF, 0x20
_MASK = [_U((1 << (8 * k)) - 1) for k in range(9)]
_MASKS = np.array(_MASK[:8], _U)


#: This worker's tables by broadcast.
_workers: dict[int, tuple] = {}


def _state_key(level: np.ndarray, context: np.ndarray) -> np.ndarray:
    return (level.astype(_U) + _U(1)) << _U(56) | context


def _cold_bit(state: np.ndarray) -> np.ndarray:
    return (mix(state) >> _U(64 - COLD_BITS)).astype(np.int64)


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, DEPTH separators before each, and where each text's own symbols begin."""
    docs = len(offsets) - 1
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # the white space right behind a word is its separator
    filled = np.flatnonzero(np.diff(offsets) > 0)
    keep[offsets[filled]] = inside[offsets[filled]]
    open_end = np.zeros(docs, np.int64)
    open_end[filled] = inside[offsets[filled + 1] - 1]
    cut = np.concatenate([[0], np.cumsum(keep)])[offsets]
    tail = open_end + 1
    at = np.repeat(np.stack([cut[:-1], cut[1:]], 1).ravel(), np.stack([np.full(docs, DEPTH), tail], 1).ravel())
    added = np.full(len(at), _SPACE, np.uint8)
    added[np.cumsum(DEPTH + tail) - 1] = _END
    out = np.insert(np.where(inside, data, np.uint8(_SPACE))[keep], at, added)
    return out, cut + DEPTH * np.arange(1, docs + 2) + np.concatenate([[0], np.cumsum(tail)])


def runs(sym: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The run of DEPTH + 1 symbols ending at each symbol of a text, packed, and the bounds of the texts' runs."""
    docs = len(starts) - 1
    bounds = np.concatenate([[0], np.cumsum(np.diff(starts) - DEPTH)])
    if not docs:
        return np.zeros(0, _U), bounds
    padded = np.zeros(len(sym) + 8 - DEPTH, np.uint8)
    padded[7 - DEPTH : 7 - DEPTH + len(sym)] = sym
    code = np.ndarray((len(sym) - DEPTH,), ">u8", padded, strides=(1,)).astype(_U) & _MASK[DEPTH + 1]
    own = np.ones(len(code), bool)
    own[(starts[1:-1, None] - 2 * DEPTH + np.arange(DEPTH)).ravel()] = False  # the separators before a text
    return code[own], bounds


def _merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[order], first) if len(keys) else n


class RunTally:
    """Counts of runs, sorted in portions."""

    def __init__(self) -> None:
        self.codes: list[np.ndarray] = []
        self.waiting = self.held = self.merged = 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, codes: np.ndarray) -> None:
        self.codes.append(codes)
        self.waiting += len(codes)
        if self.waiting > SORTED:
            self._sort()

    def _sort(self) -> None:
        ordered = np.sort(np.concatenate([np.zeros(0, _U), *self.codes]))
        self.codes, self.waiting = [], 0
        if len(ordered):
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            self.parts.append((ordered[first], np.diff(first, append=len(ordered))))
            self.held += len(first)
        if self.held > self.merged + UNMERGED and len(self.parts) > 1:
            keys, n = (np.concatenate(x) for x in zip(*self.parts))
            self.parts = []
            self.parts = [_merged(keys, n)]
            self.held = self.merged = len(self.parts[0][0])

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._sort()
        keys, n = _merged(*(np.concatenate(x) for x in zip(*self.parts))) if self.parts else (np.zeros(0, _U), np.zeros(0, np.int64))
        self.__init__()
        return keys, n


class WordTally:
    """Counts of words as their bytes."""

    def __init__(self) -> None:
        self.units = DistinctUnits()
        self.n = np.zeros(1 << 16, np.int64)
        self.raw: list[np.ndarray] = []
        self.size: list[np.ndarray] = []

    def add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        numbers, new = self.units.numbers(data, starts, ends)
        a, b = starts[new], ends[new]
        self.raw.append(strung(data, a, b - a))
        self.size.append(b - a)
        while self.units.count > len(self.n):
            self.n = np.concatenate([self.n, np.zeros_like(self.n)])
        upto = int(numbers.max(initial=-1)) + 1
        self.n[:upto] += np.bincount(numbers, minlength=upto)

    def take(self) -> tuple[pa.Array, np.ndarray]:
        raw, size = np.concatenate([np.zeros(0, np.uint8), *self.raw]), np.concatenate([np.zeros(0, np.int64), *self.size])
        n = self.n[: self.units.count]
        self.__init__()
        return _words(raw, np.cumsum(size) - size, size), n


def _words(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """The keys of words: their bytes; byte 255, which no text holds, and a digest for very long ones."""
    if len(size) and int(size.max()) > LONGEST_WORD:
        blob = raw.tobytes()
        words = (blob[a : a + n] for a, n in zip(at.tolist(), size.tolist()))
        return pa.array([w if len(w) <= LONGEST_WORD else b"\xff" + hashlib.blake2b(w, digest_size=32).digest() for w in words], pa.large_binary()).cast(pa.binary())
    flat = strung(raw, at, size)
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(flat)])


def _run_keys(codes: np.ndarray) -> pa.Array:
    """Eight bytes a run, the oldest symbol first."""
    raw = codes.astype(">u8")
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(np.arange(0, 8 * len(codes) + 1, 8, dtype=np.int32)), pa.py_buffer(raw)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): words (0), runs (1) and texts (2)."""
    _workers.clear()  # tables of an earlier model: this worker counts for a new one
    words, grams, texts = WordTally(), RunTally(), 0

    def rows(kind: int, keys: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(n), 100_000):
            some = n[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int8)), keys.slice(i, len(some)), pa.array(some)], names=["kind", "key", "n"])

    def run_rows() -> Iterator[pa.RecordBatch]:
        keys, n = grams.take()
        yield from rows(1, _run_keys(keys), n)

    for batch in S.small_batches(batches):
        for i, j, data, offsets in S.text_slices(batch.column(0)):
            data = _LOWER[data]
            starts, ends, _ = S.word_spans(data, offsets)
            words.add(data, starts, ends)
            grams.add(runs(*symbols(data, offsets))[0])
            texts += j - i
            if words.units.count > HELD_WORDS or words.units.long_bytes > 16 * HELD_WORDS:
                yield from rows(0, *words.take())
            if grams.merged > HELD_RUNS:
                yield from run_rows()
    yield from rows(0, *words.take())
    S.release_memory()
    yield from run_rows()
    yield from rows(2, pa.array([b""], pa.binary()), np.array([texts]))
    del words, grams
    S.release_memory()


class Lookup:
    """Vectorised map from uint64 keys to float32 values (NaN: absent)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length())
        slot = (mix(keys) >> _U(64 - self.bits)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        self.keys = np.append(keys[order], _U(0))
        self.values = np.append(values[order].astype(np.float32), np.float32(np.nan))
        self.first = np.searchsorted(slot[order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = (mix(keys) >> _U(64 - self.bits)).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(keys), np.nan, np.float32)
        hit = (at < end) & (self.keys[at] == keys)
        out[hit] = self.values[at[hit]]
        todo = np.flatnonzero(~hit & (at + 1 < end))
        step = 1
        while len(todo):
            p = at[todo] + step
            hit = self.keys[p] == keys[todo]
            out[todo[hit]] = self.values[p[hit]]
            step += 1
            todo = todo[~hit]
            todo = todo[at[todo] + step < end[todo]]
        return out


@dataclass
class SuffixTree:
    """entries: log10 P(symbol | state) by packed state and symbol; escapes: log10 of the weight left to the parent."""

    entries: Lookup
    escapes: Lookup
    #: Bitmap of the states that are not held here (None: all are).
    cold: np.ndarray | None = None

    def known_runs(self, code: np.ndarray) -> np.ndarray:
        """log10 P of the runs, NaN where the longest state may be one that is not held."""
        depth = np.full(len(code), -1)
        value = self.walk(code, depth)
        if self.cold is not None:
            value[self._beyond(code, depth)] = np.nan
        return value

    def _beyond(self, code: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Whether the context one symbol longer than the longest held one may be a state: ancestors of states are states."""
        longer = np.minimum(depth + 1, DEPTH)
        bit = _cold_bit(_state_key(longer, (code >> _U(8)) & _MASKS[longer]))
        return (depth < DEPTH) & ((self.cold[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)

    def walk(self, code: np.ndarray, depth: np.ndarray | None = None) -> np.ndarray:
        """log10 P of the runs by the held states; depth takes the length of the longest one."""
        out = np.zeros(len(code))
        todo = np.arange(len(code))
        for k in range(DEPTH, -1, -1):
            c = code[todo]
            level = _U(k + 1) << _U(56)
            value = self.entries.get(level | (c & _MASK[k + 1])).astype(np.float64)
            left = np.isnan(value)
            out[todo[~left]] += value[~left]
            if depth is not None:
                depth[todo[~left]] = np.maximum(depth[todo[~left]], k)
            todo, c = todo[left], c[left]
            escape = self.escapes.get(level | ((c >> _U(8)) & _MASK[k])).astype(np.float64)
            if depth is not None:
                here = todo[~np.isnan(escape)]
                depth[here] = np.maximum(depth[here], k)
            out[todo] += np.where(np.isnan(escape), 0.0, escape)
        out[todo] -= math.log10(257)
        return out


class RunCache:
    """The scores of the runs that a worker met last, one a slot."""

    def __init__(self, tree: SuffixTree):
        self.tree = tree
        self.keys = np.full(1 << CACHE_BITS, ~_U(0), _U)
        self.values = np.zeros(1 << CACHE_BITS, np.float32)

    def get(self, code: np.ndarray) -> np.ndarray:
        """tree.known_runs(code), to single precision."""
        slot = ((code * _U(0x9E3779B97F4A7C15)) >> _U(64 - CACHE_BITS)).astype(np.int64)
        out = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != code)
        if len(miss):
            new, where = np.unique(code[miss], return_inverse=True)
            value = self.tree.known_runs(new).astype(np.float32)
            out[miss] = value[where]
            slot = ((new * _U(0x9E3779B97F4A7C15)) >> _U(64 - CACHE_BITS)).astype(np.int64)
            _, last = np.unique(slot[::-1], return_index=True)
            keep = len(slot) - 1 - last
            self.keys[slot[keep]], self.values[slot[keep]] = new[keep], value[keep]
        return out.astype(np.float64)


@dataclass
class HotWords:
    """Scores of the most frequent words, by number; other words get larger numbers."""

    raw: np.ndarray
    size: np.ndarray
    scores: np.ndarray
    units: DistinctUnits = field(default_factory=DistinctUnits)

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not self.units.count or self.units.count > len(self.scores) + NUMBERED or self.units.long_bytes > 16 * NUMBERED:
            self.units, self.order = DistinctUnits(), np.zeros(0, np.int64)
            ends_of = np.cumsum(self.size)
            for i in range(0, len(self.size), 100_000):  # in the order given: held ones get their places one portion after the other
                at = (ends_of - self.size)[i : i + 100_000]
                got, _ = self.units.numbers(self.raw, at, ends_of[i : i + 100_000])
                self.order = np.concatenate([self.order, got])
            self.by_number = np.full(len(self.size), np.nan)
            self.by_number[self.order] = self.scores
        return self.units.numbers(data, starts, ends)[0]

    def values(self, numbers: np.ndarray) -> np.ndarray:
        """The scores, NaN for words that are not among the hot ones."""
        out = np.full(len(numbers), np.nan)
        hot = numbers < len(self.scores)
        out[hot] = self.by_number[numbers[hot]]
        return out


def _retained(grams: DataFrame) -> DataFrame:
    """(level, context, symbol, n, total, kinds) of the retained states."""
    level = F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("level")
    run = F.expr("key & (shiftleft(1L, 8 * (level + 1)) - 1)").alias("run")
    counts = (
        grams.select("key", "n", level)
        .select("level", run, "n")
        .groupBy("level", "run").agg(F.sum("n").alias("n"))
        .select("level", F.shiftright("run", 8).alias("context"), F.col("run").bitwiseAND(255).alias("symbol"), "n")
    )
    totals = counts.groupBy("level", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    full = materialize(counts.join(totals, ["level", "context"]).where((F.col("total") >= LEAST) | (F.col("level") == 0)), "suffix_counts")
    up = full.select((F.col("level") + 1).alias("level"), F.col("context").alias("parent"), "symbol", F.col("n").alias("pn"), F.col("total").alias("pt"))
    parent = F.expr("context & (shiftleft(1L, 8 * (level - 1)) - 1)")
    tests = (
        full.where("level > 0").withColumn("parent", parent).join(up, ["level", "parent", "symbol"])
        .groupBy("level", "context", "parent", "total", "kinds")
        .agg(F.sum(F.col("n") * F.log2((F.col("n") / F.col("total")) / (F.col("pn") / F.col("pt")))).alias("bits"))
        .select("level", "context", "parent", "kinds", (F.col("bits") - COST * F.col("kinds") * F.log2(F.col("total") + 1)).alias("gain"))
    )
    states = tests.where("gain > 0").select("level", "context")
    # Ancestors: every retained context's shorter suffixes.
    shorter = states.select(F.explode(F.sequence(F.lit(0), F.col("level"))).alias("level"), "context").select("level", F.expr("context & (shiftleft(1L, 8 * level) - 1)").alias("context"))
    root = full.where("level = 0").select("level", "context").distinct()
    return full.join(shorter.unionByName(root).distinct(), ["level", "context"]).select("level", "context", "symbol", "n", "total", "kinds")


def _least_total(kept: DataFrame, entries: int) -> int:
    """The least count of the states that fit in `entries` rows. An ancestor's count is no smaller, so it is among them."""
    room, least = entries, 1 << 62
    for r in kept.groupBy("total").agg(F.count("*").alias("rows")).orderBy(F.desc("total")).limit(entries).toLocalIterator():
        room -= r["rows"]
        if room < 0:
            break
        least = r["total"]
    return least


def _values(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, total, value) of all entries and (state, total, escape) of all states, in log10."""
    level, parent = F.col("level").cast("long"), F.expr("context & (shiftleft(1L, 8 * (level - 1)) - 1)")
    smooth = (F.col("n") + F.col("kinds") * F.col("above")) / (F.col("total") + F.col("kinds"))
    state = F.shiftleft(level + 1, 56).bitwiseOR(F.col("context"))
    key = F.shiftleft(level + 1, 56).bitwiseOR(F.shiftleft("context", 8)).bitwiseOR(F.col("symbol"))
    known, parts = None, []
    # Shorter states first: a state's smoothing reads its parent's finished values.
    for k in range(DEPTH + 1):
        here = kept.where(F.col("level") == k)
        if known is None:
            here = here.withColumn("above", F.lit(1 / 257))
        else:
            here = here.withColumn("parent", parent).join(known, ["parent", "symbol"])
        done = materialize(here.select("context", "symbol", "total", smooth.alias("p"), key.alias("key")), "suffix_values")
        known = done.select(F.col("context").alias("parent"), "symbol", F.col("p").alias("above"))
        parts.append(done.select("key", "total", F.log10("p").alias("value")))
    entries = parts[0]
    for p in parts[1:]:
        entries = entries.unionByName(p)
    states = kept.select(state.alias("state"), "total", F.log10(F.col("kinds") / (F.col("total") + F.col("kinds"))).alias("escape")).distinct()
    return entries, materialize(states, "suffix_states")


def _lookup(rows: DataFrame) -> Lookup:
    """Of rows(key, value), whose number is bounded."""
    table = rows.select("key", F.col(rows.columns[-1]).cast("float")).toArrow()
    return Lookup(table.column(0).to_numpy().astype(np.int64).view(_U), table.column(1).to_numpy().astype(np.float32))


def _cold_bitmap(states: DataFrame) -> np.ndarray:
    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_cold_bit(batch.column(0).to_numpy().view(_U)) + 1)], names=["slot"])

    rows = (
        states.select("state").mapInArrow(slots, "slot long")
        .groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    )
    out = np.zeros(1 << (COLD_BITS - 3), np.uint8)
    for r in rows.toLocalIterator():  # at most 8 MB
        out[4096 * (r["bucket"] - 1) : 4096 * r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def _cold_scores(codes: DataFrame, shared, entries: DataFrame, states: DataFrame) -> DataFrame:
    """(key, lm) of codes(key), distinct runs whose longest state may not be broadcast: log10 P by the whole tree."""

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value[0]
        for batch in batches:
            code = batch.column(0).to_numpy().view(_U)
            depth = np.full(len(code), -1)
            base = tree.walk(code, depth)
            for k in range(1, DEPTH + 1):
                at = np.flatnonzero(depth < k)
                level, c = np.full(len(at), k), code[at]
                state = _state_key(level, (c >> _U(8)) & _MASK[k])
                key = (_U(k + 1) << _U(56)) | (c & _MASK[k + 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.view(np.int64)), pa.array(level.astype(np.int32)), pa.array(state.view(np.int64)), pa.array(key.view(np.int64)), pa.array(base[at])], names=["code", "level", "state", "key", "base"]
                )

    # Where a state has no entry for the symbol, no longer one has; its escape leads to the shorter one.
    asked = codes.mapInArrow(probes, "code long, level int, state long, key long, base double").join(states, "state", "left")
    found = asked.where("escape is not null").join(entries, "key", "left").groupBy("code").agg(
        F.max_by("value", F.when(F.col("value").isNotNull(), F.col("level"))).alias("value"), F.max("base").alias("base"), F.sum(F.when(F.col("value").isNull(), F.col("escape")).otherwise(0.0)).alias("escape")
    )
    return found.select(F.col("code").alias("key"), (F.coalesce("value", "base") + F.col("escape")).alias("lm"))


def _top(counts: DataFrame, most: int) -> DataFrame:
    """Keys of the largest counts, as many as fit in `most`, by a threshold on the count."""
    room, least = most, 1 << 62
    for r in counts.groupBy("n").agg(F.count("*").alias("keys")).orderBy(F.desc("n")).limit(most).toLocalIterator():
        room -= r["keys"]
        if room < 0:
            break
        least = r["n"]
    return counts.where(F.col("n") >= least)


def _worker_tables(token: int, shared) -> tuple[RunCache, HotWords]:
    """This worker's tables of a broadcast, kept for its next tasks."""
    if token not in _workers:
        _workers.clear()
        tree, hot = shared.value
        _workers[token] = RunCache(tree), hot
    return _workers[token]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, hot_words: int = HOT_WORDS) -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score and score of every row; folds other than 0 teach."""
    bound_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    train = base.where(fold_of("id", folds) != 0).select("text")
    # A task's rows have distinct keys already, but for a few flushes: they are dealt out at once, without a useless aggregate before.
    tallies = train.mapInArrow(_count, "kind byte, key binary, n long").repartition("kind", "key")
    counts = materialize(tallies.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm_counts")
    words = counts.where("kind = 0").select("key", "n")
    grams = counts.where("kind = 1").select(F.conv(F.hex("key"), 16, 10).cast("long").alias("key"), "n")
    total = counts.where("kind <> 1").agg(F.sum("n").alias("N"), F.count_if(F.col("kind") == 0).alias("V"), F.max(F.when(F.col("kind") == 2, F.col("n"))).alias("ends")).first()
    N, ends = int(total["N"] or 0), int(total["ends"] or 0)
    V = int(total["V"] or 0) + (ends > 0)
    below = N + ADD * (V + 1)
    log_of = lambda c: math.log10((c + ADD) / below)

    kept = materialize(_retained(grams), "suffix_kept")
    least = _least_total(kept, ENTRIES)
    entries, states = _values(kept)
    tree = SuffixTree(_lookup(entries.where(F.col("total") >= least).select("key", "value")), _lookup(states.where(F.col("total") >= least).select(F.col("state").alias("key"), "escape")))
    cold = None
    if states.where(F.col("total") < least).limit(1).count():
        cold = entries.where(F.col("total") < least).select("key", "value"), states.where(F.col("total") < least).select("state", "escape")
        tree.cold = _cold_bitmap(cold[1])
    top = _top(words, hot_words).toArrow()
    top_words = top.column("key").combine_chunks().cast(pa.large_binary()) if top.num_rows else pa.array([], pa.large_binary())
    raw = b"".join(top_words.to_pylist())
    size = np.fromiter((len(w) for w in top_words.to_pylist()), np.int64, len(top_words))
    # A digest stands for a long word; its bytes are no word of a text, so it is joined.
    hot = HotWords(np.frombuffer(raw, np.uint8), size, np.log10((top.column("n").to_numpy().astype(float) + ADD) / below))
    shared = sc.broadcast((tree, hot))
    del top, top_words, raw, size
    S.release_memory()
    end_score = log_of(ends)
    token = shared._jbroadcast.id()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, table = _worker_tables(token, shared)
        for batch in S.small_batches(batches):
            ids, rows = batch.column(0), batch.column(1)
            for i, j, data, offsets in S.text_slices(batch.column(2)):
                data = _LOWER[data]
                starts, stops, bounds = S.word_spans(data, offsets)
                found = table.values(table.numbers(data, starts, stops))
                known = ~np.isnan(found)
                known_upto = np.concatenate([[0], np.cumsum(known)])
                hot_upto = np.concatenate([[0.0], np.cumsum(np.where(known, found, 0.0))])
                code, at = runs(*symbols(data, offsets))
                logs = lm.get(code)
                far = np.isnan(logs)
                lm_upto = np.concatenate([[0.0], np.cumsum(np.where(far, 0.0, logs))])
                far_at = np.concatenate([[0], np.cumsum(far)])[at].astype(np.int32)
                cut = lambda x, b: x[b[1:]] - x[b[:-1]]
                rare_at = np.concatenate([[0], np.cumsum(~known)])[bounds].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, j - i), rows.slice(i, j - i),
                        pa.array(np.diff(bounds) + 1), pa.array(cut(known_upto, bounds) + (ends > 0)),
                        pa.array(cut(hot_upto, bounds) + end_score), pa.array(cut(lm_upto, at)),
                        pa.ListArray.from_arrays(rare_at, _words(data, starts[~known], (stops - starts)[~known])),
                        pa.ListArray.from_arrays(far_at, pa.array(code[far].view(np.int64))),
                    ],
                    names=["id", "row", "n_tokens", "n_hot", "hot_score", "score", "rare", "far"],
                )

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value[0].walk(batch.column(0).to_numpy().view(_U)))], names=["key", "base"])

    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]
    rows = base.withColumn("row", F.monotonically_increasing_id()).select("id", "row", "text")
    scored = materialize(rows.mapInArrow(score, f"id {kind}, row long, n_tokens long, n_hot long, hot_score double, score double, rare array<binary>, far array<long>"), "lm_scored")
    tail = (
        scored.where(F.size("rare") > 0).select("row", F.explode("rare").alias("key"))
        .join(words, "key", "left")
        .groupBy("row")
        .agg(F.count("n").alias("n_rare"), F.sum(F.log10((F.coalesce("n", F.lit(0)) + ADD) / below)).alias("rare_score"))
    )
    lm = F.col("score")
    if cold:
        runs_of = scored.where(F.size("far") > 0).select("row", F.explode("far").alias("key"))
        asked = materialize(runs_of.select("key").distinct().mapInArrow(held, "key long, base double"), "lm_far")
        answers = asked.join(_cold_scores(asked.select("key"), shared, *cold), "key", "left").select("key", F.coalesce("lm", "base").alias("lm"))
        tail = tail.join(runs_of.join(answers, "key").groupBy("row").agg(F.sum("lm").alias("far_score")), "row", "full")
        lm = F.col("score") + F.coalesce("far_score", F.lit(0.0))
    return scored.drop("rare", "far").join(tail, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(N).cast("long").alias("train_tokens"),
        (F.col("hot_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"), lm.alias("score"),
    )
