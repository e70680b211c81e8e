"""Whitening of embedding vectors by their leading principal components.

Entries are put on a grid, ``x = floor(1024 c) + 100000``.  Each task adds up ``(x - mean)(x - mean)'`` of its vectors;
the tasks' matrices are added in rounds, and only the D x D covariance (D: the vectors' length) reaches the driver.
There Householder reflections make it tridiagonal, Sturm counts bisect its leading eigenvalues, and inverse iteration
finds their vectors, each made orthogonal to those of its cluster of close eigenvalues.  The components, at most
``COMPONENTS`` vectors, travel to the tasks, which project their vectors.

Vectors that are null, empty or hold null or non-finite entries take no part; nor do those of another length than the
most common one (ties: the longest).  ``x`` is limited to a long, as Spark's casts are; ``deviation`` is null where it
does not fit a long.  Components whose eigenvalue is nothing but rounding are left out, so equal vectors, a single one
and an empty table give no row.  Repeated rows and null ids are rows as any other; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added, array_parts, ends_of, sums

COMPONENTS, GRID, SHIFT = 8, 1024.0, 100_000
EPS = np.finfo(float).eps
#: Rows of a matrix that travel as one part.
ROWS = 64
#: Vectors a task handles at once.
BATCH = 4096


# Eigenvectors of a symmetric matrix

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder reduction: diagonal, off-diagonal and the unit reflectors (row k acts on the places after k)."""
    a, d = matrix.astype(float), len(matrix)
    reflectors = np.zeros((max(0, d - 2), d))
    for k in range(d - 2):
        v = a[k + 1:, k].copy()
        size = np.abs(v[1:]).max()
        if size <= EPS * np.abs(v).max():
            continue
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        reflectors[k, k + 1:] = v
        # H A H with H = I - 2 v v' on the trailing block, as one update of rank two.
        p = 2 * a[k + 1:, k + 1:] @ v
        w = p - (p @ v) * v
        a[k + 1:, k + 1:] -= np.outer(v, w) + np.outer(w, v)
        column = a[k + 1:, k] - 2 * v * (v @ a[k + 1:, k])
        a[k + 1:, k] = a[k, k + 1:] = column
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues of the tridiagonal matrix are smaller than each value of ``at``."""
    floor = np.finfo(float).tiny / EPS * max(1.0, float((off ** 2).max(initial=0)))
    count, q = np.zeros(len(at), int), np.zeros(len(at))
    for k in range(len(diagonal)):
        q = diagonal[k] - at - (off[k - 1] ** 2 / q if k else 0)
        # A pivot of 0 stands for a tiny negative one.
        q = np.where(np.abs(q) < floor, -floor, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, wanted: int) -> np.ndarray:
    """The ``wanted`` largest eigenvalues, falling, by bisection from the Gershgorin interval down to rounding."""
    d = len(diagonal)
    reach = np.concatenate([[0], np.abs(off)]) + np.concatenate([np.abs(off), [0]])
    low = np.full(wanted, (diagonal - reach).min())
    high = np.full(wanted, (diagonal + reach).max())
    margin = EPS * max(abs(low[0]), abs(high[0])) * d
    low, high, rank = low - margin, high + margin, d - np.arange(wanted)
    for _ in range(128):
        middle = (low + high) / 2
        # The value of rank r (from below) is smaller than the middle where r values or more are.
        left = below(diagonal, off, middle) >= rank
        high, low = np.where(left, middle, high), np.where(left, low, middle)
    return (low + high) / 2


def solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """Solves (T - shift) y = right by elimination with row exchanges; pivots of 0 become rounding."""
    d = len(diagonal)
    size = max(np.abs(diagonal).max(), np.abs(off).max(initial=0), np.finfo(float).tiny)
    a, b, c, y = diagonal - shift, np.append(off, 0.0), np.zeros(d), right.copy()
    for k in range(d - 1):
        low, mid, up = off[k], a[k + 1], b[k + 1]
        if abs(low) > abs(a[k]):
            pivot, a[k] = a[k], low
            part = pivot / low
            a[k + 1], b[k], c[k], b[k + 1] = b[k] - part * mid, mid, up, -part * up
            y[k], y[k + 1] = y[k + 1], y[k] - part * y[k + 1]
        else:
            a[k] = a[k] or EPS * size
            part = low / a[k]
            a[k + 1], y[k + 1] = mid - part * b[k], y[k + 1] - part * y[k]
    a[a == 0] = EPS * size
    for k in range(d - 1, -1, -1):
        y[k] -= (b[k] * y[k + 1] if k + 1 < d else 0) + (c[k] * y[k + 2] if k + 2 < d else 0)
        y[k] /= a[k]
        top = np.abs(y[k])
        if top > 1e200:  # only the direction counts
            y /= top
    return y


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, seed: int = 5) -> np.ndarray:
    """Rows: unit eigenvectors for falling ``values`` by inverse iteration.

    Values closer than a thousandth of the matrix's size are a cluster; a vector stays orthogonal to all before it in
    its cluster.  Equal values are moved apart by rounding, so their vectors start from different directions.
    """
    rng, size = np.random.default_rng(seed), max(np.abs(values).max(), np.finfo(float).tiny)
    out, first = np.zeros((len(values), len(diagonal))), 0
    shift = np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * size:
            first = k
        shift = min(value, shift - 4 * EPS * size)
        y = rng.standard_normal(len(diagonal))
        for _ in range(6):
            y /= np.linalg.norm(y)
            y = solved(diagonal, off, shift, y)
            y /= np.abs(y).max()
            for _ in range(2):
                y -= out[first:k].T @ (out[first:k] @ y)
            y /= np.linalg.norm(y)
        out[k] = y
    return out


def leading_components(matrix: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and their unit eigenvectors as rows; those that are only rounding are left out."""
    d = len(matrix)
    scale = np.abs(matrix).max(initial=0)
    if not scale > 0:
        return np.empty(0), np.empty((0, d))
    diagonal, off, reflectors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, min(wanted, d))
    values = values[values > 16 * d * EPS * values[0]]
    rows = vectors_of(diagonal, off, values)
    for v in reflectors[::-1]:
        rows -= 2 * np.outer(rows @ v, v)
    # The back-transformed vectors are orthogonal up to rounding; one more round removes that.
    for k in range(len(rows)):
        rows[k] -= rows[:k].T @ (rows[:k] @ rows[k])
        rows[k] /= np.linalg.norm(rows[k])
    return values * scale, rows


# Jobs

def grid(batches: Iterator[pa.RecordBatch], length: int | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches, the places of their rows that take part, and those rows' ``x`` (a matrix, if ``length`` is given)."""
    for whole in batches:
        for start in range(0, whole.num_rows, BATCH):
            batch = whole.slice(start, BATCH)
            lists = batch.column("embedding")
            sizes = np.array([n or 0 for n in lists.value_lengths().to_pylist()], np.int64)
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            bad = sums((~np.isfinite(flat)).astype(float), ends_of(sizes)) > 0
            fits = ~bad & (sizes > 0) & (True if length is None else sizes == length)
            if length is None:
                yield batch, np.flatnonzero(fits), sizes[fits]
                continue
            kept = flat[np.repeat(fits, sizes)].reshape(-1, length)
            x = np.clip(np.floor(GRID * kept) + SHIFT, -(2.0 ** 63), 2.0 ** 63 - 1024).astype(np.int64)
            yield batch, np.flatnonzero(fits), x


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, sizes in grid(batches, None):
        yield pa.RecordBatch.from_arrays([pa.array(sizes)], ["length"])


def _totals(length: int):
    """A task's sums by dimension, exact: the upper and the lower 32 bits of ``x`` are added on their own."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(length, np.int64), np.zeros(length, np.int64), 0
        for _, _, x in grid(batches, length):
            high, low, n = high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0), n + len(x)
        at = np.arange(length, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(high), pa.array(low), pa.array(np.full(length, n))],
                                         ["dim", "high", "low", "n"])

    return rows


@dataclass
class Fit:
    """What the fit list says: its size, exact sums, components with their eigenvalues, and the trace."""

    n: int
    total: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as a whole number and the rest below 1, so that differences to it keep all their digits."""
        parts = [divmod(s, self.n) for s in self.total]
        return np.array([q for q, _ in parts], np.int64), np.array([r / self.n for _, r in parts])

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.mean
        return (x - whole).astype(float) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)^2 of each row, in whole numbers; None beyond a long."""
        far = self.n * np.abs(self.centred(x)).max(initial=0) + 1
        if far ** 2 * len(self.total) < 2.0 ** 62 and self.n * float(np.abs(x).max(initial=0)) < 2.0 ** 62:
            return ((self.n * x - np.array(self.total, np.int64)) ** 2).sum(axis=1).tolist()
        whole = ((self.n * x.astype(object) - np.array(self.total, object)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in whole]


def _scatter(fit):
    """A task's sum of products of centred vectors, in parts of ROWS rows."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Fit = fit.value
        total = np.zeros((len(f.total), len(f.total)))
        for _, _, x in grid(batches, len(f.total)):
            y = f.centred(x)
            total += y.T @ y
        yield from array_parts({k: total[k * ROWS:(k + 1) * ROWS] for k in range(-(-len(total) // ROWS))})

    return rows


def _moments(fit):
    """A task's sums of whitened vectors, then of their products."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Fit = fit.value
        k = len(f.values)
        total = np.zeros((k + 1, k))
        for _, _, x in grid(batches, len(f.total)):
            w = f.whitened(x)
            total[0] += w.sum(axis=0)
            total[1:] += w.T @ w
        yield from array_parts({0: total})

    return rows


def fit_components(vectors: DataFrame, wanted: int = COMPONENTS) -> Fit | None:
    """Components of all vectors of ``vectors`` (column embedding); None if none takes part."""
    own, shared = vectors.select("embedding"), vectors.sparkSession.sparkContext
    lengths = own.mapInArrow(_lengths, "length bigint").groupBy("length").count()
    length = lengths.orderBy(F.desc("count"), F.desc("length")).head()
    if length is None:
        return None
    length = length["length"]
    # One row for each dimension.
    rows = (own.mapInArrow(_totals(length), "dim bigint, high bigint, low bigint, n bigint")
            .groupBy("dim").agg(*(F.sum(c).alias(c) for c in ("high", "low", "n"))).orderBy("dim").collect())
    fit = Fit(rows[0]["n"], [(r["high"] << 32) + r["low"] for r in rows], np.empty(0), np.empty((0, length)), 0.0)
    parts = added(own.mapInArrow(_scatter(shared.broadcast(fit)), "block int, salt int, part binary"))
    matrix = np.concatenate([parts[k].reshape(-1, length) for k in sorted(parts)]) / fit.n
    matrix = (matrix + matrix.T) / 2
    fit.values, fit.components = leading_components(matrix, wanted)
    fit.trace = float(np.trace(matrix))
    return fit


def identity_error(vectors: DataFrame, fit: Fit) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity.

    The vectors are centred by the exact mean already; what their sum is off by rounding is taken out.
    """
    sent = vectors.sparkSession.sparkContext.broadcast(fit)
    got = added(vectors.select("embedding").mapInArrow(_moments(sent), "block int, salt int, part binary"))
    k = len(fit.values)
    total = got[0].reshape(k + 1, k) / fit.n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def _whiten(fit, error: float, names: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Fit = fit.value
        k = len(f.values)
        for batch, at, x in grid(batches, len(f.total)):
            n, who = len(x), pa.array(np.repeat(at, k))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(who) for c in names), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                 pa.array(np.full(n * k, f.n, np.int64)), pa.array([v for v in f.deviation(x) for _ in range(k)], pa.int64()),
                 pa.array(f.whitened(x).reshape(-1)), pa.array(np.tile(f.values / f.trace, n)), pa.array(np.full(n * k, error))],
                [*names, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows


def whiten(vectors: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """A row for each vector of ``vectors`` (vec_id, embedding) and component."""
    shape = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    own = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    fit = fit_components(own, wanted)
    if fit is None or not len(fit.values):
        return vectors.sparkSession.createDataFrame([], shape)
    sent = vectors.sparkSession.sparkContext.broadcast(fit)
    return own.mapInArrow(_whiten(sent, identity_error(own, fit), ["vec_id"]), shape)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings, whitened by their first eight components."""
    return whiten(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))
