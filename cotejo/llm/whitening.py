"""Whitening of embeddings by a cyclic Jacobi eigenvalue decomposition.

Vectors are taken as whole numbers, so sums, scatter and covariance are exact however rows are dealt.  One pass
sums the vectors, the next one the products of what is left when the rounded mean is taken off (small numbers); what
the rounding leaves is corrected with whole numbers on the driver, which gets a matrix of the dimension's size.
There Jacobi rotations, in cyclic order, go on until no off-diagonal entry is large against its two diagonal
ones, which keeps small eigenvalues accurate.  The whitening matrix goes to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A vector's entry c counts as the whole number floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries from which on these aren't exact; such a vector has no result, like one with an infinite entry.
LARGEST = float(1 << 42)
#: The longest vectors: the driver holds a matrix of their length squared.
MOST_DIMENSIONS = 4096
#: Rows of a product, so few that it is exact in doubles for entries below 2**20.
ROWS = 4096
#: Components with a smaller share of the trace, for each dimension, are no directions but rounding.
NOTHING = 2.0**-52


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix that isn't negative.

    In each round of a sweep the indices meet in other disjoint pairs, as in a tournament, so a sweep rotates every pair
    once; it ends when every off-diagonal entry is at most the rounding of the two diagonal entries' mean.  Of a
    vector's entries the largest is positive.
    """
    a = np.array(a, np.float64)
    n = len(a)
    vectors = np.eye(n)
    seats = np.arange(n + n % 2)  # a last one without partner where n is odd
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            p, q = np.minimum(seats[:half], seats[half:][::-1]), np.maximum(seats[:half], seats[half:][::-1])
            p, q = p[q < n], q[q < n]
            off, low, high = a[p, q], a[p, p], a[q, q]
            some = np.abs(off) > 2.0**-53 * np.sqrt(np.abs(low) * np.abs(high))
            if some.any():
                turned = True
                p, q, off, low, high = p[some], q[some], off[some], low[some], high[some]
                theta = (high - low) / (2 * off)
                t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(1, theta))
                c = 1 / np.hypot(1, t)
                s = t * c
                x, y = a[:, p].copy(), a[:, q]
                a[:, p], a[:, q] = c * x - s * y, s * x + c * y
                x, y = a[p].copy(), a[q]
                a[p], a[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
                a[p, q] = a[q, p] = 0.0
                a[p, p], a[q, q] = low - t * off, high + t * off
                x, y = vectors[:, p].copy(), vectors[:, q]
                vectors[:, p], vectors[:, q] = c * x - s * y, s * x + c * y
            seats[1:] = np.roll(seats[1:], 1)
        if not turned:
            break
    values = a.diagonal().copy()
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    if n:
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(n)] < 0, -1.0, 1.0)
    return values[order], vectors


def _whole(batch: pa.RecordBatch, vector: str, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the batch that count, and their whole numbers; dim None: rows that could count, of any length, and none."""
    column = batch.column(vector)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    entries = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    bad = np.bincount(owner[~(np.abs(entries) < LARGEST)], minlength=len(lengths)) > 0  # nan isn't less
    good = np.flatnonzero((lengths > 0 if dim is None else lengths == dim) & ~bad)
    if dim is None:
        return good, lengths[good]
    at = (np.cumsum(lengths) - lengths)[good]
    return good, np.floor(SCALE * entries[at[:, None] + np.arange(dim)]).astype(np.int64) + SHIFT


@dataclass
class Whitening:
    """What a fit found: n vectors with sums per dimension, and the components' eigenvalues (falling), vectors (columns) and shares of the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    @property
    def dim(self) -> int:
        return len(self.sums)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of rows of whole numbers; the mean is taken off before anything is rounded to doubles."""
        near = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])
        return ((x - near).astype(np.float64) - rest) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - sum) ** 2 over the dimensions of each row, exact; null beyond a long."""
        y = [[self.n * int(v) - s for v, s in zip(row, self.sums, strict=True)] for row in x] if self._large(x) else self.n * x - np.array(self.sums, np.int64)
        told = [sum(v * v for v in row) for row in y] if isinstance(y, list) else (y * y).sum(1).tolist()
        return [v if v < 1 << 63 else None for v in told]

    def _large(self, x: np.ndarray) -> bool:
        """Whether a long might not hold what deviation adds up."""
        most = max((int(np.abs(x).max(initial=0))) * self.n, max(map(abs, self.sums), default=0)) * 2
        if most < 1 << 62:
            spread = int(np.abs(self.n * x - np.array(self.sums, np.int64)).max(initial=0))
            return spread * spread * self.dim >= 1 << 62
        return True


def _length(vectors: DataFrame, vector: str) -> int:
    """The length that most vectors which could count have, the least of several; 0 if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, counts = np.unique(_whole(batch, vector, None)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64()), pa.array(counts, pa.int64())], names=["length", "n"])

    counted = vectors.select(vector).mapInArrow(run, "length long, n long").groupBy("length").agg(F.sum("n").alias("n"))
    first = counted.orderBy(F.col("n").desc(), "length").limit(1).collect()
    return first[0]["length"] if first else 0


def _sums(vectors: DataFrame, vector: str, dim: int) -> tuple[int, list[int]]:
    """Number and sums per dimension of the vectors; decimals of 38 digits hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for batch in batches:
            good, x = _whole(batch, vector, dim)
            n += len(good)
            high, low = (x >> 20).sum(0), (x & (1 << 20) - 1).sum(0)  # a batch's sums of parts fit a long
            sums = [s + (int(h) << 20) + int(v) for s, h, v in zip(sums, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array([str(n), *map(str, sums)], pa.string())], names=["i", "total"])

    found = vectors.select(vector).mapInArrow(run, "i int, total string").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    got = {r["i"]: int(r["total"]) for r in found.collect()}  # a row for each dimension
    return got.get(-1, 0), [got.get(i, 0) for i in range(dim)]


def _exact_product(y: np.ndarray) -> np.ndarray:
    """y.T @ y of whole numbers: in doubles where these are exact, else in Python's integers."""
    largest = int(np.abs(y).max(initial=0))
    if largest < 1 << 20:
        f = y.astype(np.float64)
        return sum(((f[i : i + ROWS].T @ f[i : i + ROWS]).astype(np.int64) for i in range(0, len(f), ROWS)), np.zeros((y.shape[1],) * 2, np.int64))
    y = y.astype(object)
    return y.T @ y


def covariance(vectors: DataFrame, vector: str, n: int, sums: list[int]) -> np.ndarray:
    """The covariance (divisor n) of the whole numbers, each entry rounded once."""
    dim = len(sums)
    near = np.array([round(Fraction(s, n)) for s in sums], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter = np.zeros((dim, dim), object)
        for batch in batches:
            scatter = scatter + _exact_product(_whole(batch, vector, dim)[1] - near)
        for i in range(dim):  # a row's upper part each
            yield pa.RecordBatch.from_arrays([pa.array([i] * (dim - i), pa.int32()), pa.array(range(i, dim), pa.int32()), pa.array([str(v) for v in scatter[i, i:]], pa.string())], names=["i", "j", "total"])

    found = vectors.select(vector).mapInArrow(run, "i int, j int, total string").groupBy("i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    rest = [s - n * int(m) for s, m in zip(sums, near, strict=True)]
    out = np.zeros((dim, dim))
    for r in found.collect():  # a row for each pair of dimensions
        i, j = r["i"], r["j"]
        out[i, j] = out[j, i] = float(Fraction(n * int(r["total"]) - rest[i] * rest[j], n * n))
    return out


def fit(vectors: DataFrame, vector: str = "embedding", components: int = 8, dim: int | None = None) -> Whitening | None:
    """The whitening of all vectors that count (see whiten), or None if there are none."""
    dim = dim or _length(vectors, vector)
    if dim > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {dim} dimensions, over {MOST_DIMENSIONS}")
    n, sums = _sums(vectors, vector, dim) if dim else (0, [])
    if not n:
        return None
    v = covariance(vectors, vector, n, sums)
    values, found = jacobi(v)
    trace = float(v.trace())
    kept = [i for i in range(min(components, dim)) if values[i] > NOTHING * dim * trace]
    return Whitening(n, sums, values[kept], found[:, kept], values[kept] / trace if trace else values[kept])


def identity_error(vectors: DataFrame, vector: str, w: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance less the identity, taken over all vectors; 0 without components."""
    k = len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, product = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = w.project(_whole(batch, vector, w.dim)[1])
            total, product = total + y.sum(0), product + y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k + k), pa.int32()), pa.array(np.concatenate((total, product.ravel())), pa.float64())], names=["i", "total"])

    if not k:
        return 0.0
    got = {r["i"]: r["total"] for r in vectors.select(vector).mapInArrow(run, "i int, total double").groupBy("i").agg(F.sum("total").alias("total")).collect()}
    mean = np.array([got[i] for i in range(k)]) / w.n
    found = np.array([got[k + i] for i in range(k * k)]).reshape(k, k) / w.n - np.outer(mean, mean)
    return float(np.abs(found - np.eye(k)).max())


def whiten(vectors: DataFrame, vector: str = "embedding", row_id: str = "vec_id", components: int = 8, dim: int | None = None) -> DataFrame:
    """A row for each vector that counts and each component (int, from 1): row_id, n (long), deviation (long), whitened, explained, identity_error.

    vectors has row_id and the array of numbers ``vector``.  A vector counts if it and its entries aren't null, all are finite
    (and below 2**42) and it has ``dim`` of them, by default the length that most have.  Its entry c is floor(1024 * c) + 100000; n
    vectors count.  deviation is the sum of (n * x - sum) ** 2 over the dimensions, exact, null beyond a long;
    whitened the centred vector on the component over the root of its eigenvalue; explained the eigenvalue's share of the
    trace; identity_error one value for all.  Directions in which the vectors don't spread are no
    components: fewer than ``components`` are returned, and none where all vectors are the same.  Repeated rows count and are returned each;
    ids may be null.  Without vectors that count the result is empty.  Other columns are not read.
    """
    vectors = vectors.select(row_id, vector)
    kind = f"{row_id} {vectors.schema[row_id].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    w = fit(vectors, vector, components, dim)
    if w is None:
        return vectors.sparkSession.createDataFrame([], kind)
    error, k = identity_error(vectors, vector, w), len(w.values)
    sent = vectors.sparkSession.sparkContext.broadcast(w)  # the dimension times the components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            good, x = _whole(batch, vector, w.dim)
            ids = batch.column(row_id).take(pa.array(np.repeat(good, k)))
            each = lambda values, kind: pa.array(np.tile(values, len(good)), kind)  # noqa: E731, B023
            deviation = pa.array(w.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(good)), k)))
            whitened = pa.array(w.project(x).ravel(), pa.float64())
            yield pa.RecordBatch.from_arrays([ids, each(np.arange(1, k + 1), pa.int32()), pa.array(np.full(len(ids), w.n), pa.int64()), deviation, whitened, each(w.explained, pa.float64()), pa.array(np.full(len(ids), error))], names=[row_id, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, kind)
