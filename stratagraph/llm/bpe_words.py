"""BPE encoding through a distinct-word table, and decoding through an id-to-piece table.

1. Cut: texts are cut into words (units of `word_cache`: a word with the white space in front of it). Texts
   are taken in chunks of about CHUNK_BYTES; a chunk is written as its distinct words, dealt into buckets by the
   words' hashes, and as the number of the word at each position of its texts.
2. Encode: a bucket's words of all chunks meet in one task, where each distinct word is encoded once.
   So the distinct-word table is the buckets together; it is never sent anywhere whole.
3. Join: the ids come back to their chunk and are put at the words' positions.
4. Decoding joins ids to pieces, a table of the vocabulary's fixed size, by position, and reads the bytes as UTF-8
   (bad sequences become U+FFFD, as the library does).

A bucket has one row a chunk, and a word one place in its bucket's row, however often texts hold it: a hot word
weighs as much as any other. Positions are packed, so what is shuffled is about half of the texts.
A task that holds over `word_cache.UnitIds.MOST` words (which more shuffle partitions prevent) forgets them and goes on.

Defined results
- Null and empty texts: no ids, empty decoded text. Strings of special tokens in a text become
  those tokens, as in the library. Very long texts are taken whole, as a chunk of their own.
- Repeated rows are each answered, rows without id too; ties do not arise. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import bound_batches, materialize, text_of
from .word_cache import DistinctUnits, UnitEncoder, UnitIds, byte_alphabet, strung, unit_spans

#: Bytes of text of a chunk; a longer text is a chunk alone. Smaller ones take less memory of a task and more disk.
CHUNK_BYTES = 1 << 25
#: Compression levels of positions, and of words and their ids, which are fewer and travel more.
_FAST, _DENSE = 9, 15
_HEAD = np.dtype("<u8")


def _packed(level: int, kinds: str, *arrays: np.ndarray) -> bytes:
    """Arrays compressed together. kinds: i for integers under 2 ** 32 as byte planes, n for integers as they are, b for bytes."""
    parts: list[bytes] = []
    for kind, a in zip(kinds, arrays):
        if kind == "b":
            parts.append(a.tobytes())
            continue
        width = 1 if not len(a) else max(1, (int(a.max()).bit_length() + 7) // 8)
        if kind == "n":
            width = 2 if width <= 2 else 4
            parts.append(bytes([width]) + a.astype(f"<u{width}").tobytes())
        else:
            planes = np.ascontiguousarray(a, "<u4").view(np.uint8).reshape(len(a), 4)
            parts.append(bytes([width]) + b"".join(planes[:, k].tobytes() for k in range(width)))
    head = np.array([len(p) for p in parts], _HEAD).tobytes()
    size = len(head) + sum(map(len, parts))
    return np.array([size], _HEAD).tobytes() + pa.Codec("zstd", compression_level=level).compress(b"".join([head, *parts]), asbytes=True)


def _unpacked(blob: bytes, kinds: str) -> list[np.ndarray]:
    """The arrays again, integers as uint32."""
    raw = pa.Codec("zstd").decompress(memoryview(blob)[8:], decompressed_size=int(np.frombuffer(blob, _HEAD, 1)[0]), asbytes=True)
    sizes, out, at = np.frombuffer(raw, _HEAD, len(kinds)).tolist(), [], 8 * len(kinds)
    for kind, n in zip(kinds, sizes):
        a = np.frombuffer(raw, np.uint8, n, at)
        at += n
        if kind == "n":
            a = np.frombuffer(raw, f"<u{a[0]}", (n - 1) // int(a[0]), at - n + 1).astype("<u4")
        elif kind == "i":
            planes = a[1:].reshape(int(a[0]), -1)
            a = planes[0].astype("<u4")
            for k in range(1, len(planes)):
                a |= planes[k].astype("<u4") << np.uint32(8 * k)
        out.append(a)
    return out


def _numbers(labels: np.ndarray) -> np.ndarray:
    """The numbers that labels stand for."""
    first = labels == 0
    return np.where(first, np.cumsum(first, dtype=np.int32) - 1, labels.view(np.int32) - 1)


class _Chunk:
    """What is gathered of a chunk: rows, units of each, a label for each unit, and the distinct units' bytes.

    Distinct units are numbered by their first place. A label is 0 at a first place and the number + 1 elsewhere: half of
    the distinct words of a chunk are met once.
    """

    def __init__(self, buckets: int, spaces: bool):
        self.buckets, self.spaces = buckets, spaces
        self.units = DistinctUnits()
        self.by_place = np.zeros(1 << 16, np.uint32)  # of the units' own numbers
        self.rows: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []
        self.labels: list[np.ndarray] = []
        self.raw: list[np.ndarray] = []
        self.raw_sizes: list[np.ndarray] = []
        self.bucket: list[np.ndarray] = []
        self.held = 0

    def add(self, rows: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        starts, ends, bounds = unit_spans(data, offsets, self.spaces)
        before = self.units.count
        numbers, new = self.units.numbers(data, starts, ends)
        while self.units.count > len(self.by_place):
            self.by_place = np.concatenate([self.by_place, np.zeros_like(self.by_place)])
        order = np.argsort(new)
        self.by_place[before + order] = np.arange(before, self.units.count, dtype=np.uint32)
        labels = self.by_place[numbers] + np.uint32(1)
        labels[new] = 0
        new = new[order]
        a, b = starts[new], ends[new]
        self.rows.append(rows)
        self.sizes.append(np.diff(bounds).astype(np.uint32))
        self.labels.append(labels)
        self.raw.append(strung(data, a, b - a))
        self.raw_sizes.append((b - a).astype(np.uint32))
        self.bucket.append((S.span_hashes(data, a, b) % np.uint64(self.buckets)).astype(np.uint32))
        self.held += len(data)

    def written(self, number: int) -> Iterator[tuple]:
        """(chunk, bucket, ids, blob): a row of positions (bucket -1), and one for each bucket with a unit."""
        raw, size, bucket = np.concatenate(self.raw), np.concatenate(self.raw_sizes).astype(np.int64), np.concatenate(self.bucket)
        at = np.cumsum(size) - size
        labels, self.labels = np.concatenate(self.labels), []
        yield number, -1, pa.concat_arrays(self.rows), _packed(_FAST, "iii", np.concatenate(self.sizes), labels, bucket)
        del labels
        order = np.argsort(bucket, kind="stable")
        for of in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(of):
                yield number, int(bucket[of[0]]), None, _packed(_DENSE, "ib", size[of], strung(raw, at[of], size[of]))


def _cut(kind: pa.DataType, buckets: int, spaces: bool, chunk_bytes: int):
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        ids = [r[2] for r in rows]
        upto = np.cumsum([0, *(0 if x is None else len(x) for x in ids)])
        flat = pa.concat_arrays([pa.array([], kind), *(x for x in ids if x is not None)])
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), flat), pa.array([r[3] for r in rows], pa.binary())], names=["chunk", "bucket", "ids", "blob"]
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.release_memory()  # what this worker still holds of other stages
        number = TaskContext.get().partitionId() << 33
        chunk = _Chunk(buckets, spaces)
        for batch in S.small_batches(batches):
            for i, j, data, offsets in S.text_slices(batch.column(1)):
                chunk.add(batch.column(0).slice(i, j - i), data, offsets)
                if chunk.held >= chunk_bytes:
                    yield batch_of([*chunk.written(number)])
                    number, chunk = number + 1, _Chunk(buckets, spaces)
                    S.release_memory()
        if chunk.rows:
            yield batch_of([*chunk.written(number)])

    return cut


def _encode(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.release_memory()
        table = UnitIds(UnitEncoder(path, True, "<u4"))
        for batch in S.small_batches(batches, 100):
            out = []
            for blob in batch.column(2):
                size, raw = _unpacked(blob.as_py(), "ib")
                ends = np.cumsum(size, dtype=np.int64)
                at, n = table.look_up(raw, ends - size, ends)
                out.append(_packed(_DENSE, "in", n, strung(table.ids, at, n)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["chunk", "bucket", "blob"])

    return encode


def pieces(path: str) -> list[bytes]:
    """Bytes of each id: the byte-level alphabet undone; special tokens are their own text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    found = {i: bytes(byte_of[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    found |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [found.get(i, b"") for i in range(max(found) + 1)]


class PieceTable:
    """Pieces by id in flat arrays."""

    def __init__(self, path: str):
        table = pieces(path)
        self.size = np.array([len(p) for p in table], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(table), np.uint8)

    def texts(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Bytes of the texts whose ids lie between bounds; not always whole characters."""
        size = self.size[ids]
        raw = memoryview(strung(self.raw, self.at[ids], size))
        cut = np.concatenate([[0], np.cumsum(size)])[bounds].tolist()
        return [bytes(raw[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def _runs(sizes: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of rows with about `limit` units at most, one row at least."""
    ends = np.cumsum(sizes, dtype=np.int64)
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (int(ends[i - 1]) if i else 0) + limit, side="right")))
        yield i, j
        i = j


def _join(path: str, id_col: str, columns: list[tuple[str, pa.DataType]]):
    names = [c for c, _ in columns]

    def join(key: tuple, chunk: pa.Table) -> pa.Table:
        table = _worker_pieces(path) if any(c.startswith("decoded") for c in names) else None
        of_bucket = chunk.column("bucket").to_pylist()
        mine = of_bucket.index(-1)
        sizes, labels, bucket = _unpacked(chunk.column("blob")[mine].as_py(), "iii")
        rows, numbers = chunk.column("ids")[mine].values, _numbers(labels)
        at, n, ids = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64), [np.zeros(0, "<u4")]
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(int(bucket.max(initial=0)) + 2))
        filled = 0
        for k, blob in zip(of_bucket, chunk.column("blob")):
            if k >= 0:
                size, got = _unpacked(blob.as_py(), "in")
                of = order[first[k] : first[k + 1]]
                n[of] = size
                at[of] = filled + np.cumsum(size, dtype=np.int64) - size
                filled += len(got)
                ids.append(got)
        ids = np.concatenate(ids)
        upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        out = []
        for i, j in _runs(sizes):
            here = numbers[upto[i] : upto[j]]
            size = n[here]
            flat = strung(ids, at[here], size)
            bounds = np.concatenate([[0], np.cumsum(size)])[upto[i : j + 1] - upto[i]]
            raw, cut = memoryview(flat).cast("B"), (4 * bounds).tolist()
            views = [raw[a:b] for a, b in zip(cut[:-1], cut[1:])]
            texts = [t.decode("utf-8", "replace") for t in table.texts(flat, bounds)] if table else []
            made = {
                "n_tokens": lambda: np.diff(bounds),
                "ids": lambda: [bytes(v) for v in views],
                "decoded": lambda: texts,
                "ids_sha256": lambda: [hashlib.sha256(v).hexdigest() for v in views],
                "decoded_sha256": lambda: [hashlib.sha256(t.encode()).hexdigest() for t in texts],
            }
            out.append(pa.RecordBatch.from_arrays([rows.slice(i, j - i), *(pa.array(made[c](), t) for c, t in columns)], names=[id_col, *names]))
        return pa.Table.from_batches(out)

    return join


_piece_tables: dict[str, PieceTable] = {}


def _worker_pieces(path: str) -> PieceTable:
    """This worker's piece table, kept for its next chunks."""
    if path not in _piece_tables:
        _piece_tables[path] = PieceTable(path)
    return _piece_tables[path]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False, digests: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """id_col, n_tokens, ids (little-endian unsigned 32-bit) and, if asked for, the decoded text of every row.

    digests: SHA-256 of ids and decoded text in place of themselves.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = dict(base.dtypes)["id"]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    arrow = base.select("id").limit(0).toArrow().schema.field("id").type
    written = materialize(base.mapInArrow(_cut(arrow, buckets, True, chunk_bytes), f"chunk long, bucket int, ids array<{kind}>, blob binary"), "bpe_chunks")
    words = written.where("bucket >= 0").select("chunk", "bucket", "blob").repartition("bucket")
    answers = words.mapInArrow(_encode(path), "chunk long, bucket int, blob binary")
    parts = written.where("bucket < 0").unionByName(answers, allowMissingColumns=True)
    columns: list[tuple[str, pa.DataType]] = [("n_tokens", pa.int64()), *([("ids_sha256", pa.string())] if digests else [("ids", pa.binary())])]
    if decode:
        columns.append(("decoded_sha256" if digests else "decoded", pa.string()))
    types = {"n_tokens": "long", "ids": "binary"}
    return parts.groupBy("chunk").applyInArrow(_join(path, id_col, columns), ", ".join([f"`{id_col}` {kind}", *(f"{c} {types.get(c, 'string')}" for c, _ in columns)]))


def decode_texts(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and the decoded text of rows whose ids are little-endian unsigned 32-bit integers; null: empty."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(path)
        for batch in S.small_batches(batches, 100):
            blobs = [b or b"" for b in batch.column(1).to_pylist()]
            bounds = np.cumsum([0, *(len(b) // 4 for b in blobs)])
            texts = table.texts(np.frombuffer(b"".join(blobs), "<u4"), bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=[id_col, "decoded"])

    base = encoded.select(id_col, ids_col)
    return base.mapInArrow(decode, f"`{id_col}` {dict(base.dtypes)[id_col]}, decoded string")
