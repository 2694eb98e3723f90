"""Vectorised hashing of words and word shingles over Arrow string columns, and exact set similarity."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes of text that are hashed in one go; a longer text is taken alone.
SLICE_BYTES = 1 << 19

_U = np.uint64
#: Masks of the first 0 to 8 bytes of a little-endian integer.
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], _U)
#: Stretches of more bytes than this are hashed by BLAKE2.
MIXED_BYTES = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser over uint64: every output bit depends on every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in runs of few rows (no copies), so that copies made of a run are small; frees memory at the end."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    release_memory()


def release_memory() -> None:
    """Give freed memory back to the system: the worker stays for other tasks, of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them); null texts are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of each word in order, and where each text's words begin (one more entry at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The little-endian integer of the eight bytes from each position on; zeros follow the data."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_part(view: np.ndarray, starts: np.ndarray, n: np.ndarray, part: int) -> np.ndarray:
    """Bytes 8 * part to 8 * part + 7 of stretches of n bytes that reach that far, as integers."""
    return view[starts + 8 * part] & _FIRST_BYTES[np.minimum(n - 8 * part, 8)]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch of bytes: a mix after every eight of them. Stretches of up to eight bytes never share one with another of their length."""
    n = ends - starts
    h = mix(n.astype(_U) + _U(0x9E3779B97F4A7C15))
    if not len(n):
        return h
    view = eight_bytes(data)
    at = np.flatnonzero(n > 0)
    for part in range(-(-min(int(n.max()), MIXED_BYTES) // 8)):
        at = at[n[at] > 8 * part]
        h[at] = mix(h[at] ^ span_part(view, starts[at], n[at], part))
    for k in np.flatnonzero(n > MIXED_BYTES).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return h


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word in order, and where each text's words begin."""
    starts, ends, bounds = word_spans(data, offsets)
    return span_hashes(data, starts, ends), bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all five-word shingles with their text's number; a shorter text is one shingle of its words."""
    n = np.diff(bounds)
    salts = [_U(s) for s in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]
    text = np.repeat(np.arange(len(n)), n)
    if len(words) >= SHINGLE:
        m = len(words) - SHINGLE + 1
        full = np.arange(m) + SHINGLE <= bounds[text[:m] + 1]
        at = np.flatnonzero(full)
        s = np.zeros(len(at), _U)
        for k in range(SHINGLE):
            s = s + words[at + k] * salts[k]
        owner = text[at]
    else:
        s, owner = np.zeros(0, _U), np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        t = np.zeros(len(short), _U)
        for k in range(SHINGLE - 1):
            has = n[short] > k
            t[has] = t[has] + words[bounds[short[has]] + k] * salts[k]
        s, owner = np.concatenate([s, t]), np.concatenate([owner, short])
    return mix(s), owner


def sequence_digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128-bit BLAKE2 digest of each text's words, joined by single spaces, as two int64."""
    starts, ends, bounds = word_spans(data, offsets)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    between = np.ones(len(starts), bool)
    between[bounds[1:][np.diff(bounds) > 0] - 1] = False  # the last word of each text
    keep = inside.copy()
    keep[ends[between]] = True
    kept = np.where(inside, data, np.uint8(32))[keep]
    cut = np.concatenate([[0], np.cumsum(keep)])[offsets]
    out = [hashlib.blake2b(kept[a:b], digest_size=16).digest() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
    return np.frombuffer(b"".join(out), "<i8").reshape(len(out), 2)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of one whole text."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    words, bounds = word_hashes(data, np.array([0, len(data)]))
    return np.unique(shingle_hashes(words, bounds)[0])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
