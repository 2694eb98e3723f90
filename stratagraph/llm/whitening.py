"""Embedding whitening: compensated covariance and a divide-and-conquer eigen-solve.

Sums and centred outer products are kept as pairs of doubles (high, low), made by error-free transformations: a sum or a
product of two doubles is the rounded result and its exact rounding error. So sums of integers below 2^106 are exact, and a
covariance has about 32 digits before it is rounded once, however many rows there are and however large the mean is.

1. Each task adds its vectors: a pair of arrays and a count. Pairs of tasks meet by key, first in blocks of tasks, then whole.
2. With the mean, a pair too, each task adds outer products of centred vectors, and sends each row of its upper triangle
   once; rows meet as in 1. No task holds more than a few matrices, and the driver gets one.
3. The driver solves the matrix (dimension by dimension, so bounded by the vectors' length) with LAPACK's symmetric
   divide-and-conquer driver behind `numpy.linalg.eigh`: reduction to tridiagonal form, then divide and conquer.
4. Each task projects its centred vectors on the components and divides by the roots of the eigenvalues.

Defined results
- Rows whose vector is null, empty, or holds null or non-finite entries go. Vectors of another length than the most frequent
  one (ties: the shorter) go too: no covariance takes both.
- Repeated rows and repeated or null ids: each row counts and is returned by itself.
- Ties between eigenvalues: the order that the solver gives, the same for all rows. A component's largest coordinate is positive.
- An eigenvalue that is no larger than RANK of the trace has no root to divide by: its component and what follows give null.
- A table without usable rows gives no rows. Extra columns, whatever their names, are ignored unless carried.
- Entries are expected below 2^500, so that no product overflows; larger ones make results non-finite.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize

#: Share of the trace from which on an eigenvalue counts as one.
RANK = 2.0**-44
#: Doubles of a block of rows at once, and tasks whose sums meet first.
BLOCK, MEET = 1 << 15, 64

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """(a + b, its rounding error)."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _quick_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """The same where |a| >= |b|."""
    s = a + b
    return s, b - (s - a)


def halves(a: np.ndarray) -> Pair:
    """a as two numbers of 26 bits, so that products of halves are exact."""
    c = 134217729.0 * a
    high = c - (c - a)
    return high, a - high


def two_product(a: np.ndarray, b: np.ndarray, a_halves: Pair, b_halves: Pair) -> Pair:
    """(a * b, its rounding error)."""
    p = a * b
    (ah, al), (bh, bl) = a_halves, b_halves
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(a: Pair, b: Pair) -> Pair:
    """Sum of two pairs, to about 106 bits."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = _quick_sum(s, e + t)
    return _quick_sum(s, e + f)


def total(pair: Pair) -> Pair:
    """Sum along the first axis, halving it again and again."""
    high, low = pair
    while (n := len(high)) > 1:
        half = n // 2
        h, m = add((high[:half], low[:half]), (high[half : 2 * half], low[half : 2 * half]))
        high, low = (np.concatenate([h, high[2 * half :]]), np.concatenate([m, low[2 * half :]])) if n % 2 else (h, m)
    return high[0], low[0]


def divided(pair: Pair, n: int) -> Pair:
    """A pair over a whole number below 2^53."""
    by = np.float64(n)
    q = pair[0] / by
    p, e = two_product(q, by, halves(q), halves(by))
    return _quick_sum(q, (((pair[0] - p) - e) + pair[1]) / by)


def centred(x: np.ndarray, mean: Pair) -> Pair:
    s, e = two_sum(x, -mean[0])
    return _quick_sum(s, e - mean[1])


def outer_products(x: np.ndarray, mean: Pair) -> Iterator[tuple[int, Pair]]:
    """(i, sum over the rows of x of coordinate i times coordinates i and later, all centred)."""
    high, low = centred(x, mean)
    split = halves(high)
    for i in range(x.shape[1]):
        one = slice(i, i + 1)
        p, e = two_product(high[:, one], high[:, i:], (split[0][:, one], split[1][:, one]), (split[0][:, i:], split[1][:, i:]))
        yield i, total(_quick_sum(p, e + (high[:, one] * low[:, i:] + low[:, one] * high[:, i:])))


def usable(vectors: DataFrame, vector_col: str = "embedding", carry: dict[str, Column] | None = None) -> DataFrame:
    """`vector` (doubles) and the carried expressions of the rows whose vector is there, not empty, and finite throughout."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return vectors.where((F.size(v) > 0) & finite).select(*[c.alias(n) for n, c in (carry or {}).items()], v.cast("array<double>").alias("vector"))


def _blocks(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Vectors of one length as matrices of BLOCK doubles at most, for each length in a batch."""
    column = batch.column(batch.schema.get_field_index("vector"))
    flat, ends = np.asarray(column.values), np.asarray(column.offsets)
    sizes = np.diff(ends)
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        for k in range(0, len(rows), step := max(1, BLOCK // dim)):
            yield flat[ends[rows[k : k + step], None] + np.arange(dim)]


_PARTS = "dim int, i int, task int, n long, high array<double>, low array<double>"


def _emit(held: dict[tuple[int, int], tuple[int, Pair]], task: int) -> pa.RecordBatch:
    keys, values = list(held), list(held.values())
    ints = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([task] * len(keys), pa.int32()), pa.array([n for n, _ in values], pa.int64())]
    return pa.RecordBatch.from_arrays([*ints, *[pa.array([p[s] for _, p in values], pa.list_(pa.float64())) for s in (0, 1)]], names=[c.split()[0] for c in _PARTS.split(", ")])


def _meet(parts: DataFrame) -> DataFrame:
    """Parts of one (dim, i) added up: those of MEET tasks first, then what comes of them. A task holds one sum a key."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[int, Pair]] = {}
        task = 0
        for b in batches:
            dims, rows, tasks, ns, high, low = b.columns
            for k in range(len(b)):
                key = dims[k].as_py(), rows[k].as_py()
                new = np.asarray(high[k].values), np.asarray(low[k].values)
                n, old = held.get(key, (0, None))
                held[key] = n + ns[k].as_py(), new if old is None else add(old, new)
                task = tasks[k].as_py()
        if held:
            yield _emit(held, task)

    for block in (F.expr(f"task div {MEET}"), F.lit(0)):
        parts = parts.withColumn("task", block.cast("int")).repartition("dim", "i", "task").mapInArrow(merge, _PARTS)
    return parts


def sums(rows: DataFrame) -> DataFrame:
    """(dim, n, high, low): count and sum of the vectors of each length."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[int, Pair]] = {}
        for b in batches:
            for x in _blocks(b):
                new, key = total((x, np.zeros_like(x))), (x.shape[1], 0)
                n, old = held.get(key, (0, None))
                held[key] = n + len(x), new if old is None else add(old, new)
        if held:
            yield _emit(held, TaskContext.get().partitionId())

    return _meet(rows.select("vector").mapInArrow(add_up, _PARTS)).select("dim", "n", "high", "low")


def scatter(rows: DataFrame, mean: Pair) -> np.ndarray:
    """Sum of the outer products of centred vectors, rounded once."""
    dim = len(mean[0])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[int, Pair]] = {}
        for b in batches:
            for x in _blocks(b):
                for i, new in outer_products(x, mean) if x.shape[1] == dim else ():
                    n, old = held.get((dim, i), (0, None))
                    held[dim, i] = n + len(x), new if old is None else add(old, new)
        if held:
            yield _emit(held, TaskContext.get().partitionId())

    out = np.zeros((dim, dim))
    for r in _meet(rows.select("vector").mapInArrow(add_up, _PARTS)).select("i", "high").toLocalIterator():  # dim rows
        out[r["i"], r["i"] :] = out[r["i"] :, r["i"]] = r["high"]
    return out


@dataclass(frozen=True)
class Whitening:
    """What the rows teach: n, the exact sums, and components (rows, as many as there are roots) by falling eigenvalue."""

    n: int
    sums: Pair
    mean: Pair
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def dim(self) -> int:
        return len(self.mean[0])


def fit(rows: DataFrame, k: int = 8) -> Whitening | None:
    """Whitening of rows(vector) to k components at most; None where there is no row. rows are read twice."""
    best = sums(rows).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not best:
        return None
    n, added = best[0]["n"], (np.array(best[0]["high"]), np.array(best[0]["low"]))
    mean = divided(added, n)
    covariance = scatter(rows, mean) / n
    values, vectors = np.linalg.eigh(covariance)
    trace = float(np.trace(covariance))
    chosen = [j for j in range(len(values) - 1, -1, -1)[:k] if values[j] > RANK * trace]
    components = vectors[:, chosen].T.copy()
    components *= np.sign(components[np.arange(len(chosen)), np.abs(components).argmax(axis=1)])[:, None] if chosen else 1
    return Whitening(n, added, mean, components, values[chosen], trace)


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """rows of the model's length with `whitened` (doubles, as many as the model has components) in place of `vector`."""
    scale = (model.components / np.sqrt(model.eigenvalues)[:, None]).T if len(model.components) else np.zeros((model.dim, 0))
    mean, dim, keep = model.mean, model.dim, [c for c in rows.columns if c != "vector"]
    width = scale.shape[1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index("vector"))
            start, flat = column.offsets[0].as_py(), np.asarray(column.values)
            x = flat[start : start + dim * len(b)].reshape(len(b), dim)
            out = centred(x, mean)[0] @ scale
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * width, pa.int32()), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in keep], made], names=[*keep, "whitened"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "vector")
    bound_batches(rows.sparkSession)
    return rows.where(F.size("vector") == dim).mapInArrow(project, f"{kinds}, whitened array<double>" if kinds else "whitened array<double>")


def identity_error(white: DataFrame) -> float | None:
    """Largest absolute entry of the covariance of `whitened` minus the identity, measured over all rows; None without components."""
    rows = white.where(F.size("whitened") > 0).select(F.col("whitened").alias("vector"))
    found = sums(rows).collect()  # one row: all are of one length
    if not found:
        return None
    n = found[0]["n"]
    covariance = scatter(rows, divided((np.array(found[0]["high"]), np.array(found[0]["low"])), n)) / n
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whitened_components(vectors: DataFrame, id_col: str, vector_col: str, k: int = 8, carry: dict[str, object] | None = None) -> DataFrame:
    """A row for each usable vector and component: id_col, component, n, carried columns, whitened, explained, identity_error.

    carry: name -> function of the model that gives an expression over `vector`.
    """
    rows = usable(vectors, vector_col, {"__id": F.col(id_col)})
    model = fit(rows, k)
    names = list(carry or {})
    if model is None:
        kinds = vectors.schema[id_col].dataType.simpleString()
        extra = "".join(f", `{n}` long" for n in names)
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kinds}, component int, n long{extra}, whitened double, explained double, identity_error double")
    made = rows.where(F.size("vector") == model.dim).select("__id", *[f(model).alias(f"__c_{n}") for n, f in (carry or {}).items()], "vector")
    white = materialize(whiten(made, model), "whitened")
    error = identity_error(white)
    width = min(k, model.dim)
    explained = [float(e / model.trace) for e in model.eigenvalues]
    explained += [0.0 if model.trace > 0 else None] * (width - len(explained))
    numbered = F.posexplode(F.sequence(F.lit(0), F.lit(width - 1)))
    out = white.select("__id", *[f"__c_{n}" for n in names], "whitened", numbered.alias("__p", "__j"))
    return out.select(
        F.col("__id").alias(id_col), (F.col("__j") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), *[F.col(f"__c_{n}").alias(n) for n in names],
        F.get("whitened", F.col("__j")).alias("whitened"), F.get(F.array(*[F.lit(e).cast("double") for e in explained]), F.col("__j")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
