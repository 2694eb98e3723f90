"""Token ids of whole texts through the distinct strings that they are made of, equal to the tokenizers library's own.

A text is cut into units that the tokenizer treats alike wherever they stand. For a tokenizer that drops white
space a unit is a word; for one that keeps it, a unit is a stretch of white space with the word behind it, because
its pre-tokens take white space in front of a word and never behind one. A space of another alphabet next to ASCII
white space keeps two stretches in one unit. Special tokens hold no white space, so they lie within a unit.

Units are told apart by their bytes: those of up to LONGEST_UNIT bytes are held and compared as they are,
longer ones are looked up as Python bytes. No hash stands for a unit.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from . import shingles as S

#: Characters on whose class (letter, digit, space, other) and case all Unicode versions agree.
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e¡-¨«-±´¶-¸»¿-įĲ-ňŊ-ž]|<\|")
#: Fixed patterns of the two supported pre-tokenizers.
_BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_LOWER_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Eight-byte parts of a unit that are held.
PARTS = 3
LONGEST_UNIT = 8 * PARTS

_U = np.uint64


def byte_alphabet() -> list[str]:
    """The letter that byte-level models write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_LETTERS = byte_alphabet()


def unit_spans(data: np.ndarray, offsets: np.ndarray, spaces: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of each unit in order, and where each text's units begin (one more entry at the end)."""
    if not spaces:
        return S.word_spans(data, offsets)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    back = [np.concatenate([np.zeros(k, np.uint8), data[:-k]])[: len(data)] for k in (1, 2, 3)]
    before, second, third = back
    odd = (before >= 0x1C) & (before <= 0x1F)
    if (data >= 0x80).any():
        odd |= (second == 0xC2) & ((before == 0x85) | (before == 0xA0))
        odd |= (third == 0xE1) & (second == 0x9A) & (before == 0x80)
        odd |= (third == 0xE2) & (second == 0x80) & (((before >= 0x80) & (before <= 0x8A)) | (before == 0xA8) | (before == 0xA9) | (before == 0xAF))
        odd |= (third == 0xE2) & (second == 0x81) & (before == 0x9F)
        odd |= (third == 0xE3) & (second == 0x80) & (before == 0x80)
    begins = white & ~odd
    begins[1:] &= ~white[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begins[edges] = True
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets).astype(np.int64)


class Merges:
    """A file's byte-pair merges, applied to many pre-tokens at once: in each turn every pre-token replaces its pair of least rank.

    That is the library's order as long as no symbol is used by a merge of lower rank than one that makes it (`ordered`).
    """

    BITS = 19

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.byte = np.array([vocab[c] for c in _LETTERS], np.int32)
        self.last = np.array([vocab[c + end] for c in _LETTERS], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        rank = np.arange(len(pairs))
        made_at = np.full(max(vocab.values()) + 1, -1)
        np.maximum.at(made_at, self.made, rank)
        self.ordered = bool((made_at[left] < rank).all() and (made_at[right] < rank).all())
        self.keys, self.ranks = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, len(pairs), np.int32)
        key = left << 32 | right
        slot, todo = self._slot(key), rank
        while len(todo):
            _, one = np.unique(slot, return_index=True)
            one = one[self.keys[slot[one]] < 0]
            self.keys[slot[one]], self.ranks[slot[one]] = key[todo[one]], todo[one]
            slot, todo = np.delete(slot, one) + 1 & (1 << self.BITS) - 1, np.delete(todo, one)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(_U) * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.BITS)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        out = self.ranks[slot]
        todo = np.flatnonzero(self.keys[slot] != key)
        while len(todo):
            out[todo] = len(self.made)
            todo = todo[self.keys[slot[todo]] >= 0]
            slot[todo] = slot[todo] + 1 & (1 << self.BITS) - 1
            hit = self.keys[slot[todo]] == key[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit]
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        parts = [self._encode(pieces[k : k + 50_000]) for k in range(0, len(pieces), 50_000)]
        return np.concatenate([np.zeros(0, np.int32), *(p for p, _ in parts)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        piece = np.repeat(np.arange(len(pieces)), size)
        sym = self.byte[raw]
        ends = np.cumsum(size) - 1
        ends = ends[size > 0]
        sym[ends] = self.last[raw[ends]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.made)
        while len(sym):
            rank = np.full(len(sym), none, np.int32)
            rank[:-1] = np.where(piece[:-1] == piece[1:], self._rank(sym[:-1], sym[1:]), none)
            first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            n = np.diff(first, append=len(sym))
            least = np.repeat(np.minimum.reduceat(rank, first), n)
            over = least == none
            if over.any():
                done.append((piece[over], sym[over]))
                piece, sym, rank, least = piece[~over], sym[~over], rank[~over], least[~over]
            hit = np.flatnonzero(rank == least) if len(sym) else np.zeros(0, np.int64)
            # One symbol again and again: every second pair.
            close = np.flatnonzero(np.diff(hit) == 1)
            if len(close):
                fresh = np.concatenate([[True], np.diff(close) > 1])
                begin = close[fresh][np.cumsum(fresh) - 1]
                hit = np.delete(hit, close[(close - begin) % 2 == 0] + 1)
            sym[hit] = self.made[rank[hit]]
            alive = np.ones(len(sym), bool)
            alive[hit + 1] = False
            piece, sym = piece[alive], sym[alive]
        of = np.concatenate([np.zeros(0, np.int64), *(p for p, _ in done)])
        order = np.argsort(of, kind="stable")
        return np.concatenate([np.zeros(0, np.int32), *(s for _, s in done)])[order], np.bincount(of, minlength=len(pieces))


class UnitEncoder:
    """Ids of single units, by the library's rules. spaces: the tokenizer keeps white space; else it drops it and lower-cases."""

    def __init__(self, path: str, spaces: bool, dtype: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.spaces = spaces
        self.dtype = np.dtype(dtype)
        self.merges = Merges(path)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and how many each has. Plain units are cut and merged here, others go to the library whole."""
        cut = (_BYTE_LEVEL if self.spaces else _LOWER_WORDS).findall
        pieces: list[bytes] = []
        ends: list[int] = []
        odd: list[int] = []
        for k, u in enumerate(units):
            if u.isascii() and (u.isalpha() or self.spaces and u[:1] == " " and u[1:].isalpha()):
                pieces.append((u if self.spaces else u.lower()).encode())  # one pre-token
            elif u.isascii() and u[:-1].isalpha() and not self.spaces and not u[-1].isalnum() and u.isprintable():
                low = u.lower().encode()  # a word and a mark
                pieces += (low[:-1], low[-1:])
            elif not self.merges.ordered or _OTHER.search(u):
                odd.append(k)
            else:
                pieces += [p.encode() for p in cut(u if self.spaces else u.lower())]
            ends.append(len(pieces))
        ids, n = self.merges.encode(pieces)
        upto = np.concatenate([[0], np.cumsum(n)])
        last = upto[np.array(ends, np.int64)]
        size = np.diff(last, prepend=0)
        ids = ids.astype(self.dtype)
        if odd:
            extra = [np.array(self.tokenizer.encode(units[k], add_special_tokens=False).ids, self.dtype) for k in odd]
            where = last[odd]
            ids = np.insert(ids, np.repeat(where, [len(x) for x in extra]), np.concatenate(extra))
            size[odd] = [len(x) for x in extra]
        return ids, size


class DistinctUnits:
    """Distinct units of runs of text, numbered from 0 as they come."""

    BITS = 17

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.slots = np.zeros(1 << bits, np.int32)  # 0: empty, else entry + 1
        self.parts = [np.zeros(1 << bits - 1, _U) for _ in range(PARTS)]
        self.sizes = np.zeros(1 << bits - 1, np.uint8)
        self.held_as = np.zeros(1 << bits - 1, np.int32)
        self.held = 0
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0
        self.count = 0

    @staticmethod
    def _hash(parts: list[np.ndarray], size: np.ndarray) -> np.ndarray:
        h = S.mix(parts[0] ^ (size.astype(_U) << _U(56)))
        at = np.flatnonzero(size > 8)
        h[at] = S.mix(h[at] ^ S.mix(parts[1][at] + parts[2][at] * _U(0x9E3779B97F4A7C15)))
        return h

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each unit, and the places (in starts) of those that are new, in order of their numbers."""
        n = ends - starts
        out = np.full(len(n), -1, np.int64)
        fresh: list[np.ndarray] = []
        short = np.flatnonzero(n <= LONGEST_UNIT)
        if len(short):
            view = S.eight_bytes(data)
            size = n[short]
            first = starts[short]
            parts = [np.zeros(len(short), _U) for _ in range(PARTS)]
            at = np.flatnonzero(size > 0)
            for p in range(PARTS):
                at = at[size[at] > 8 * p]
                parts[p][at] = S.span_part(view, first[at], size[at], p)
            h = self._hash(parts, size)
            size = size.astype(np.uint8)
            todo = np.arange(len(short))
            while len(todo):
                missing = self._find(h, parts, size, todo, out, short)
                if not len(missing):
                    break
                # Of the missing ones with one hash the first is added; others of that hash are looked for again.
                _, one = np.unique(h[missing], return_index=True)
                new = np.sort(missing[one])
                self._add(h[new], [p[new] for p in parts], size[new])
                fresh.append(short[new])
                todo = missing
        places = np.concatenate(fresh) if fresh else np.zeros(0, np.int64)
        tail = []
        for k in np.flatnonzero(n > LONGEST_UNIT).tolist():
            raw = data[starts[k] : ends[k]].tobytes()
            if raw not in self.long:
                self.long[raw] = self.count
                self.long_bytes += len(raw)
                self.count += 1
                tail.append(k)
            out[k] = self.long[raw]
        return out, np.concatenate([places, np.array(tail, np.int64)])

    def _find(self, h: np.ndarray, parts: list[np.ndarray], size: np.ndarray, todo: np.ndarray, out: np.ndarray, short: np.ndarray) -> np.ndarray:
        """Write the numbers of held units to out; the rest of todo is returned."""
        slot = (h[todo] >> _U(64 - self.bits)).astype(np.int64)
        missing = []
        while len(todo):
            entry = self.slots[slot] - 1
            there = entry >= 0
            same = there & (self.parts[0][entry] == parts[0][todo]) & (self.sizes[entry] == size[todo])
            more = np.flatnonzero(same & (size[todo] > 8))
            for p in range(1, PARTS):
                same[more] &= self.parts[p][entry[more]] == parts[p][todo[more]]
            out[short[todo[same]]] = self.held_as[entry[same]]
            if not there.all():
                missing.append(todo[~there])
            on = np.flatnonzero(there & ~same)
            todo, slot = todo[on], (slot[on] + 1) & (len(self.slots) - 1)
        return np.sort(np.concatenate(missing)) if missing else todo

    def _add(self, h: np.ndarray, parts: list[np.ndarray], size: np.ndarray) -> None:
        while 2 * (self.held + len(h)) > len(self.slots):
            self._grow()
        entries = np.arange(self.held, self.held + len(h))
        for p in range(PARTS):
            self.parts[p][entries] = parts[p]
        self.sizes[entries], self.held_as[entries] = size, np.arange(self.count, self.count + len(h))
        self.held += len(h)
        self.count += len(h)
        self._place((h >> _U(64 - self.bits)).astype(np.int64), entries)

    def _place(self, slot: np.ndarray, entries: np.ndarray) -> None:
        while len(entries):
            free = np.flatnonzero(self.slots[slot] == 0)
            self.slots[slot[free]] = entries[free] + 1  # of several the last one stays
            todo = self.slots[slot] != entries + 1
            slot, entries = (slot[todo] + 1) & (len(self.slots) - 1), entries[todo]

    def _grow(self) -> None:
        self.bits += 1
        twice = lambda x: np.concatenate([x, np.zeros_like(x)])
        self.parts, self.sizes, self.held_as = [twice(p) for p in self.parts], twice(self.sizes), twice(self.held_as)
        self.slots = np.zeros(1 << self.bits, np.int32)
        h = self._hash([p[: self.held] for p in self.parts], self.sizes[: self.held])
        self._place((h >> _U(64 - self.bits)).astype(np.int64), np.arange(self.held))


class UnitIds:
    """Ids of units, each encoded once. What is remembered is forgotten when it holds over MOST units or ids, and encoded again."""

    MOST = 1 << 20

    def __init__(self, encoder: UnitEncoder):
        self.encoder = encoder
        self.clear()

    def clear(self) -> None:
        self.units = DistinctUnits()
        self.ids = np.zeros(1 << 16, self.encoder.dtype)
        self.at = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)
        self.filled = 0

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each unit are in `self.ids`, and how many they are; valid until the next call."""
        if self.units.count > self.MOST or self.filled > 8 * self.MOST or self.units.long_bytes > self.MOST:
            self.clear()
        numbers, new = self.units.numbers(data, starts, ends)
        if len(new):
            raw = data.tobytes()
            a, b = starts[new].tolist(), ends[new].tolist()
            ids, n = self.encoder.encode([raw[x:y].decode() for x, y in zip(a, b)])
            first = self.units.count - len(new)
            while self.filled + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while self.units.count > len(self.at):
                self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
            self.ids[self.filled : self.filled + len(ids)] = ids
            self.at[first : self.units.count] = self.filled + np.cumsum(n) - n
            self.size[first : self.units.count] = n
            self.filled += len(ids)
        return self.at[numbers], self.size[numbers].astype(np.int64)

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a row, and where each text's begin (one more entry at the end)."""
        starts, ends, bounds = unit_spans(data, offsets, self.encoder.spaces)
        at, size = self.look_up(data, starts, ends)
        return strung(self.ids, at, size), np.concatenate([[0], np.cumsum(size)])[bounds]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers."""
        out: list[bytes] = []
        for _, _, data, offsets in S.text_slices(pa.array(texts, pa.large_string())):
            ids, bounds = self.encode_slice(data, offsets)
            out += [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return out


def strung(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of values that begin at `at`, one after the other."""
    upto = np.cumsum(size)
    total = int(upto[-1]) if len(upto) else 0
    return values[np.repeat(at - upto + size, size) + np.arange(total)]


def text_runs(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of at most `limit` characters, one text at least."""
    run: list[str] = []
    first = size = 0
    for k, t in enumerate(column):
        t = t.as_py() or ""
        if run and size + len(t) > limit:
            yield first, run
            first, run, size = k, [], 0
        run.append(t)
        size += len(t)
    if run:
        yield first, run
