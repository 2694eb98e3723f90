"""Token-id storage compressed by Re-Pair grammars, with random access.

File format: a Parquet data set that Spark writes (so that lost executors and any file system are
covered), one row a block: shard, block, the block's first position in its shard, n_ids, n_docs, the smallest and
largest document id, and a binary payload. Blocks ascend in (shard, block). A payload holds a whole number
of documents, about BLOCK_IDS ids, as little-endian arrays behind a header of eight uint32:

    magic 'RPR3', documents d, rules r, symbols s, ids n, first rule f, bytes of a symbol w (2 or 4), documents without id z
    int64[d]   document ids (the first z of them are 0 and mean none)
    uint32[d]  ids of each document
    w[r]       rule's left symbol    w[r]  rule's right symbol    uint32[r]  rule's expansion length
    w[s]       the sequence; the symbol f + k is rule k, others are ids

Re-Pair replaces frequent adjacent pairs by nonterminals, again and again, within a block. A turn replaces all
pairs that are met as often as a bar, which starts at a fraction SHARE of the largest count and falls by it each turn down to
LEAST_COUNT; where two chosen pairs overlap the more frequent one is replaced. Pairs are counted by sorting those
whose hashed slot reaches the bar, so no count is a guess. It ends when no pair is met LEAST_COUNT times (a rule
then costs more bytes than it saves) or, for two-byte symbols, when all 65,536 are in use.
The expansion lengths let a reader find any document's part of the sequence by one running
sum and expand only that (`Block.ids`, `read_documents`).

Defined results
- Null and empty texts are stored as the end id alone. Documents ascend by id; ids equal in several rows ascend by
  the text's hash, then the text. Rows without id come first and are read back without one.
- Empty table: no blocks, no rows. Very long texts make a larger block. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shingles as S
from .common import BROADCAST_ROWS, bound_batches, materialize, text_of
from .word_cache import UnitEncoder, UnitIds, strung

BLOCK_IDS = 1 << 20
#: The bar of a turn, as a share of the largest count at first, then of the bar before.
SHARE = 1 / 4
#: A rule costs eight bytes (two symbols of two bytes and a length); each replacement saves two.
LEAST_COUNT = 6
#: Rules of up to this length are copied from a table when read, longer ones are taken apart first.
COPIED = 64
#: Ids that a reader expands at once, a document at least.
READ_IDS = 1 << 18
SLOT_BITS = 18
END = 2
_MAGIC = 0x33525052  # 'RPR3'


def _replace(seq: np.ndarray, at: np.ndarray, code: np.ndarray, first: int) -> np.ndarray:
    """Replace the pairs that begin at `at` by first + code, their rank: of overlapping ones the lower rank wins, then the earlier."""
    while True:
        clash = np.flatnonzero(np.diff(at) == 1)
        if not len(clash):
            break
        lose = np.zeros(len(at), bool)
        lose[clash[code[clash] > code[clash + 1]]] = True
        lose[clash[code[clash] < code[clash + 1]] + 1] = True
        # A run of one rank: every second occurrence of it.
        same = clash[code[clash] == code[clash + 1]]
        if len(same):
            fresh = np.concatenate([[True], np.diff(same) > 1])
            begin = same[fresh][np.cumsum(fresh) - 1]
            lose[same[(same - begin) % 2 == 0] + 1] = True
        at, code = at[~lose], code[~lose]
    out = seq.copy()
    out[at] = (first + code).astype(seq.dtype)
    alive = np.ones(len(seq), bool)
    alive[at + 1] = False
    return out[alive]


def repair(ids: np.ndarray, first_rule: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, left, right, length) of symbols as wide as `ids`, uint16 or uint32; rule k is the symbol first_rule + k."""
    narrow = ids.dtype == np.uint16
    wide, bits = (np.uint32, 16) if narrow else (np.uint64, 32)
    most = (1 << bits) - first_rule
    seq = ids
    left, right, length = np.zeros(0, ids.dtype), np.zeros(0, ids.dtype), np.zeros(0, np.uint32)
    factor = wide(0x9E3779B1 if narrow else 0x9E3779B97F4A7C15)
    rank_of, pair_of = np.full(1 << SLOT_BITS, -1, np.int32), np.zeros(1 << SLOT_BITS, wide)
    bar = None
    while len(seq) > 1 and len(left) < most:
        pair = seq[:-1].astype(wide) << wide(bits)
        pair |= seq[1:]
        slot = (pair * factor) >> wide(2 * bits - SLOT_BITS)
        in_slot = np.bincount(slot.astype(np.intp), minlength=1 << SLOT_BITS)
        bar = max(least, int((in_slot.max() if bar is None else bar) * SHARE))
        at = np.flatnonzero((in_slot >= bar)[slot])
        ordered = np.sort(pair[at])
        begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        count = np.diff(begin, append=len(ordered))
        many = np.flatnonzero(count >= bar)
        if not len(many):
            if bar == least:
                break
            continue
        many = many[np.argsort(-count[many], kind="stable")][: most - len(left)]
        chosen = ordered[begin[many]]
        # One chosen pair a slot, the most frequent of them; another waits for the next turn.
        _, one = np.unique((chosen * factor) >> wide(2 * bits - SLOT_BITS), return_index=True)
        chosen = chosen[np.sort(one)]
        own = (chosen * factor) >> wide(2 * bits - SLOT_BITS)
        rank_of[own], pair_of[own] = np.arange(len(chosen), dtype=np.int32), chosen
        hit = (rank_of[slot[at]] >= 0) & (pair_of[slot[at]] == pair[at])
        at = at[hit]
        code = rank_of[slot[at]]
        rank_of[own] = -1
        new_left, new_right = (chosen >> wide(bits)).astype(ids.dtype), (chosen & wide((1 << bits) - 1)).astype(ids.dtype)
        sizes = [np.where(x >= first_rule, length[np.maximum(x.astype(np.int64) - first_rule, 0)] if len(length) else 1, 1) for x in (new_left, new_right)]
        seq = _replace(seq, at, code, first_rule + len(left))
        left, right = np.concatenate([left, new_left]), np.concatenate([right, new_right])
        length = np.concatenate([length, (sizes[0] + sizes[1]).astype(np.uint32)])
    return seq, left, right, length


def pack_block(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, first_rule: int) -> bytes:
    """Payload of documents in order, those without id first. ids: uint16 or uint32."""
    none = sum(i is None for i in doc_ids)
    seq, left, right, length = repair(ids, first_rule)
    head = np.array([_MAGIC, len(doc_ids), len(left), len(seq), len(ids), first_rule, seq.dtype.itemsize, none], "<u4")
    docs = np.array([i or 0 for i in doc_ids], "<i8")
    return b"".join(p.tobytes() for p in (head, docs, sizes.astype("<u4"), left, right, length, seq))


class Block:
    """A payload's documents; `ids(i, j)` expands only the symbols that cover documents i to j - 1."""

    def __init__(self, payload: bytes):
        magic, d, r, s, self.n_ids, self.first_rule, width, self.without_id = np.frombuffer(payload, "<u4", 8).tolist()
        if magic != _MAGIC:
            raise ValueError("not a block of this format")
        symbol, at, parts = f"<u{width}", 32, []
        for kind, n in (("<i8", d), ("<u4", d), (symbol, r), (symbol, r), ("<u4", r), (symbol, s)):
            parts.append(np.frombuffer(payload, kind, n, at))
            at += parts[-1].nbytes
        self.docs, self.sizes, self.left, self.right, self.length, self.seq = parts
        self.ends = np.cumsum(self.sizes, dtype=np.int64)
        self.upto = np.cumsum(self._lengths(self.seq), dtype=np.int64)
        self._store: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _lengths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.uint32)
        rule = np.flatnonzero(symbols >= self.first_rule)
        out[rule] = self.length[symbols[rule].astype(np.int64) - self.first_rule]
        return out

    def _apart(self, symbols: np.ndarray, over: int) -> np.ndarray:
        """Rules of a length over `over` taken apart."""
        while True:
            rule = self._lengths(symbols) > over
            if not rule.any():
                return symbols
            ends = np.cumsum(1 + rule)
            out = np.empty(int(ends[-1]), symbols.dtype)
            out[ends[~rule] - 1] = symbols[~rule]
            k = symbols[rule].astype(np.int64) - self.first_rule
            out[ends[rule] - 2], out[ends[rule] - 1] = self.left[k], self.right[k]
            symbols = out

    def _expanded(self, symbols: np.ndarray) -> np.ndarray:
        if self._store is None:
            short = np.flatnonzero(self.length <= COPIED)
            size = np.zeros(len(self.length), np.int64)
            size[short] = self.length[short]
            self._store = self._apart((short + self.first_rule).astype(self.seq.dtype), 1), np.cumsum(size) - size, size
        store, at, size = self._store
        symbols = self._apart(symbols, COPIED)
        rule = symbols >= self.first_rule
        k = np.where(rule, symbols.astype(np.int64) - self.first_rule, 0)
        n = np.where(rule, size[k] if len(size) else 1, 1)
        # Ids stand behind the expansions, each for itself.
        plain = np.flatnonzero(~rule)
        where = np.zeros(len(symbols), np.int64)
        where[rule] = at[k[rule]]
        where[plain] = len(store) + np.arange(len(plain))
        return strung(np.concatenate([store, symbols[plain]]), where, n)

    def ids(self, i: int, j: int) -> np.ndarray:
        begin, end = (int(self.ends[i - 1]) if i else 0), (int(self.ends[j - 1]) if j else 0)
        if begin == end:
            return self.seq[:0]
        a, b = int(np.searchsorted(self.upto, begin, side="right")), int(np.searchsorted(self.upto, end, side="left")) + 1
        skip = begin - (int(self.upto[a - 1]) if a else 0)
        return self._expanded(self.seq[a:b])[skip : skip + end - begin]

    def runs(self, limit: int = READ_IDS) -> Iterator[tuple[int, int, np.ndarray]]:
        """(i, j, ids of documents i to j - 1) of all documents, at most about `limit` ids at once."""
        i = 0
        while i < len(self.sizes):
            upto = (int(self.ends[i - 1]) if i else 0) + limit
            j = max(i + 1, int(np.searchsorted(self.ends, upto, side="right")))
            yield i, j, self.ids(i, j)
            i = j


_encoders: dict[str, UnitIds] = {}


def _worker_encoder(path: str) -> UnitIds:
    """This worker's encoder, kept for its next tasks."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = UnitIds(UnitEncoder(path, False, "<u4"))
    return _encoders[path]


def write_token_blocks(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, shards: int | None = None) -> DataFrame:
    """Encode every text, append `end`, and write the blocks in ascending order of id; the written data set is returned.

    Shards are ranges of (id, hash of the text), as many as the session has shuffle partitions unless given, so rows of one id, or without one, spread too.
    """

    def encode(texts: pa.Array, encoder: UnitIds) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for i, j, data, offsets in S.text_slices(texts):
            ids, bounds = encoder.encode_slice(data, offsets)
            n = np.diff(bounds)
            yield i, j, np.insert(ids, bounds[1:], end), n + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(path)
        vocabulary = encoder.encoder.tokenizer.get_vocab_size()
        first_rule = max(vocabulary, end + 1)
        symbol = np.uint16 if first_rule < 1 << 16 else np.uint32
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        sizes: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held
            payload = pack_block(ids, np.concatenate(sizes), np.concatenate(parts), first_rule)
            known = [i for i in ids if i is not None]
            row = (shard, block, start, held, len(ids), min(known, default=None), max(known, default=None), payload)
            out = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), *[pa.int64()] * 6, pa.binary()))], names=["shard", "block", "start", "n_ids", "n_docs", "min_id", "max_id", "payload"])
            block, start, held = block + 1, start + held, 0
            for x in (ids, sizes, parts):
                x.clear()
            return out

        for batch in S.small_batches(batches):
            of = batch.column(0).to_pylist()
            for i, j, flat, n in encode(batch.column(1), encoder):
                ids += of[i:j]
                sizes.append(n)
                parts.append(flat.astype(symbol))
                held += len(flat)
                if held >= BLOCK_IDS:
                    yield flush()
        if ids:
            yield flush()

    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = base.repartitionByRange(*([shards] if shards else []), F.asc_nulls_first("id"), "tie")
    ordered = dealt.sortWithinPartitions(F.asc_nulls_first("id"), "tie", "text").select("id", "text")
    blocks = ordered.mapInArrow(pack, "shard int, block long, start long, n_ids long, n_docs long, min_id long, max_id long, payload binary")
    return materialize(blocks, "token_blocks")


def _based(blocks: DataFrame) -> DataFrame:
    """Blocks with `begin`, the number of ids before them in all shards."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row a shard, that is a task
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offset = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    side = F.broadcast(offset) if totals.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else offset
    return blocks.join(side, "shard").withColumn("begin", F.col("start") + F.col("offset"))


def _reader(id_col: str, wanted: frozenset | None, with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.small_batches(batches, 1):
            for begin, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = Block(payload.as_py())
                if wanted is None:
                    runs = block.runs()
                else:
                    hits = [k for k, i in enumerate(block.docs.tolist()) if k >= block.without_id and i in wanted]
                    runs = ((k, k + 1, block.ids(k, k + 1)) for k in hits)
                for i, j, ids in runs:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    ends = block.ends[i:j]
                    sizes = block.sizes[i:j].astype(np.int64)
                    cut = 4 * (ends - (int(ends[0]) - int(sizes[0])))
                    views = [raw[a:b] for a, b in zip((cut - 4 * sizes).tolist(), cut.tolist())]
                    known = np.arange(i, j) >= block.without_id
                    out = [pa.array(block.docs[i:j], mask=~known), pa.array(begin + ends - sizes), pa.array(sizes), pa.array([zlib.crc32(v) for v in views], pa.int64())]
                    if with_ids:
                        out.append(pa.array([v.tobytes() for v in views], pa.binary()))
                    yield pa.RecordBatch.from_arrays(out, names=[id_col, "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return read


def _schema(id_col: str, with_ids: bool) -> str:
    return f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids


def read_token_blocks(blocks: DataFrame, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """id_col, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids (little-endian uint32) of every stored document."""
    return _based(blocks).select("begin", "payload").mapInArrow(_reader(id_col, None, with_ids), _schema(id_col, with_ids))


def read_documents(blocks: DataFrame, ids: list[int], id_col: str = "doc_id") -> DataFrame:
    """The same of the documents asked for: other blocks are not opened, other documents not expanded."""
    may = F.lit(False)
    for i in ids:
        may = may | F.lit(i).between(F.col("min_id"), F.col("max_id"))
    return _based(blocks).where(may).select("begin", "payload").mapInArrow(_reader(id_col, frozenset(ids), True), _schema(id_col, True))
