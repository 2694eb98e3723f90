"""DartMinHash: sparse weighted minwise signatures from hashed darts.

Each element owns the strip [0, infinity) x [0, infinity) of (weight, rank). Darts are thrown
into it by hashing: the strip is cut into cells of at most unit area and every cell gets a
Poisson number of darts, whose places, ranks and coordinates follow from the element's hash
and the cell alone. A dart counts for a set if its weight lies below the element's weight;
each of the k coordinates keeps its dart of smallest rank. Two sets agree in a coordinate
with probability equal to their weighted Jaccard similarity. Only ranks up to about
k (ln k + 3) / weight are looked at, which costs O(elements + k log k) a set.
"""

from __future__ import annotations

import math

import numpy as np

from .shingles import mix

_U = np.uint64
#: Ranks below 1 are cut at these powers of two, so that sets of large weight look at few cells.
_LOW = 8
_EDGES = [0.0] + [2.0 ** -(_LOW - i) for i in range(_LOW + 1)]


def _poisson_steps(area: float) -> np.ndarray:
    p, total, steps = math.exp(-area), 0.0, []
    for k in range(1, 24):
        total += p
        steps.append(min(total, 1.0))
        p *= area / k
    return np.array(steps)


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(np.float64) * 2.0**-53


def _throw(seed: np.ndarray, owner: np.ndarray, part: np.ndarray | None, low: np.ndarray | float, area: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts of cells: owner, coordinate, rank. part: weight of the strip that counts, None for all."""
    n = np.searchsorted(_poisson_steps(area), _uniform(seed), side="right")
    has = np.flatnonzero(n)
    n = n[has]
    at = np.repeat(has, n)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    h = mix(seed[at] + _U(0x9E3779B97F4A7C15) * (nth.astype(_U) + _U(1)))
    rank = (low if np.isscalar(low) else low[at]) + area * _uniform(h)
    h = mix(h + _U(0x632BE59BD9B4E019))
    own = owner[at]
    coordinate = (h % _U(k)).astype(np.int64)
    if part is not None:
        ok = _uniform(mix(h + _U(0x8CB92BA72F3D8DD7))) < part[at]
        own, coordinate, rank = own[ok], coordinate[ok], rank[ok]
    return own, coordinate, rank


def _round(h: np.ndarray, owner: np.ndarray, part: np.ndarray | None, upto: np.ndarray, best: np.ndarray, k: int) -> None:
    """Lower best[set * k + coordinate] to the smallest rank of the darts below the set's limit."""
    limit = upto[owner]
    for c in range(len(_EDGES) - 1):
        lo, hi = _EDGES[c], _EDGES[c + 1]
        at = np.flatnonzero(limit > lo)
        if not len(at):
            return
        seed = mix(h[at] ^ mix(np.array([c + 1], dtype=_U))[0])
        own, coordinate, rank = _throw(seed, owner[at], None if part is None else part[at], lo, hi - lo, k)
        np.minimum.at(best, own * k + coordinate, rank)
    at = np.flatnonzero(limit > 1)
    if len(at):
        cells = np.ceil(limit[at] - 1).astype(np.int64)
        rep = np.repeat(at, cells)
        cell = np.arange(len(rep)) - np.repeat(np.cumsum(cells) - cells, cells) + 1
        seed = mix(h[rep] + mix(cell.astype(_U) + _U(1000)))
        own, coordinate, rank = _throw(seed, owner[rep], None if part is None else part[rep], cell.astype(np.float64), 1.0, k)
        np.minimum.at(best, own * k + coordinate, rank)


def signatures(h: np.ndarray, owner: np.ndarray, sets: int, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """uint32 signatures, one row of k a set; a set without elements has zeros.

    h: element hashes (uint64), owner: number of each element's set; an element that is
    given twice with one weight counts once. weights: None for 1 each.
    """
    if weights is None:
        part, total = None, np.bincount(owner, minlength=sets).astype(np.float64)
    else:
        strips = np.ceil(weights).astype(np.int64)
        total = np.bincount(owner, weights=weights, minlength=sets)
        rep = np.repeat(np.arange(len(h)), strips)
        strip = np.arange(len(rep)) - np.repeat(np.cumsum(strips) - strips, strips)
        part = np.minimum(1.0, weights[rep] - strip)
        h, owner = mix(h[rep] + strip.astype(_U) * _U(0xD1B54A32D192ED03)), owner[rep]
    best = np.full((sets, k), np.inf)
    upto = k * (math.log(k) + 3) / np.maximum(total, 1e-9)
    open_sets = total > 0
    while open_sets.any():
        at = open_sets[owner]
        _round(h[at], owner[at], None if part is None else part[at], upto, best.reshape(-1), k)
        # A rank above the limit is no proof of being the smallest; such coordinates are looked at again.
        open_sets = open_sets & (best > upto[:, None]).any(axis=1)
        upto = np.where(open_sets, upto * 2, upto)
    out = (mix(best.view(_U)) >> _U(32)).astype(np.uint32)
    out[total <= 0] = 0
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """int64 keys, one row of `bands` a set, from runs of `rows` coordinates."""
    cut = sig[:, : bands * rows].reshape(len(sig), bands, rows).astype(_U)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U), (len(sig), bands)).copy()
    for r in range(rows):
        key = mix(key * _U(0x9E3779B97F4A7C15) + cut[:, :, r])
    return key.view(np.int64)
