"""Embedding whitening: principal components of a distributed covariance.

Every entry c of a vector becomes the integer ``floor(64 * c) + 1000000``; the fit list
holds each different integer vector once, so copies do not weigh.  The covariance
(divisor n) is summed by Spark: tasks multiply integers that are centred at the
integer nearest to the mean, so products and sums are whole numbers, the same in every
order while they stay below 2**53, and what the mean is off by (half a unit at most) is
one rank-one term at the end.

The leading eigenvalues of that matrix, whose size is the dimension and not the table,
come from Householder tridiagonalisation and bisection by Sturm counts; the vectors
from inverse iteration, in which close eigenvalues are kept orthogonal, and the way
back through the reflections.  The projection is sent to the tasks.

Input: ``embeddings`` (vec_id, embedding).  A vector that is null or holds a null or
non-finite entry takes no part; neither does an empty one, nor one whose length is not
the most frequent one (of equally frequent ones the longest).  Entries beyond 2**55 in
size count as 2**55.  Repeated rows, and rows without vec_id, are each returned.
Components of no variance (below the rounding of the largest one) cannot be whitened and
are left out: with one different vector, or an empty table, there are none, and so no
rows.  ``deviation`` is null where it does not fit a long.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlantern.llm.common import stored

COMPONENTS = 16
#: Fixed values of the integer scale.
SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 55)
#: Rows multiplied at once.
BLOCK_ROWS = 4096
#: Eigenvalues closer than this share of the matrix norm are one cluster.
CLUSTER = 1e-3
_EPS = float(np.finfo(float).eps)


# ------------------------------------------------------------ eigenvalues

def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """(diagonal, off-diagonal, reflections) of a symmetric matrix, by Householder.

    A reflection is (first row it changes, unit vector); applied in order to both sides
    of ``v`` they leave the tridiagonal matrix.
    """
    a = np.array(v, float)
    d = len(a)
    reflections = []
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        largest = np.abs(x).max()
        if not np.abs(x[1:]).max() > _EPS * _EPS * largest:
            a[k + 2 :, k] = a[k, k + 2 :] = 0.0
            continue
        u = x / largest
        u[0] += np.copysign(np.sqrt(u @ u), u[0])
        u /= np.sqrt(u @ u)
        reflections.append((k + 1, u))
        block = a[k + 1 :, k + 1 :]
        p = block @ u
        p -= (u @ p) * u
        block -= 2.0 * (np.outer(u, p) + np.outer(p, u))
        x -= 2.0 * (u @ x) * u
        a[k + 1 :, k] = a[k, k + 1 :] = x
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of ``at``: negative terms of the Sturm sequence."""
    tiny = _EPS * max(np.abs(diagonal).max(), np.abs(off).max() if len(off) else 0.0) or 1e-300
    count = np.zeros(len(at), int)
    q = np.ones(len(at))
    for i, a in enumerate(diagonal):
        q = a - at - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < tiny * _EPS, -tiny * _EPS, q)
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection down to the last bit."""
    d = len(diagonal)
    radius = np.zeros(d)
    if d > 1:
        radius[:-1] += np.abs(off)
        radius[1:] += np.abs(off)
    low = np.full(k, (diagonal - radius).min() - 1e-300)
    high = np.full(k, (diagonal + radius).max())
    high += _EPS * np.abs(high) + 1e-300
    above = d - np.arange(k)  # eigenvalue j (from 0) has d - j at or below it
    while True:
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any():
            return high
        below = sturm_counts(diagonal, off, middle) < above
        low, high = np.where(below, middle, low), np.where(below, high, middle)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; a vanishing pivot becomes ``tiny``."""
    d = len(diagonal)
    main, upper, second, x = diagonal - shift, np.append(off, 0.0), np.zeros(d), b.copy()
    lower = off
    for i in range(d - 1):
        if abs(lower[i]) > abs(main[i]):
            main[i], f = lower[i], main[i] / lower[i]
            upper[i], main[i + 1] = main[i + 1], upper[i] - f * main[i + 1]
            second[i], upper[i + 1] = upper[i + 1], -f * upper[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
        else:
            if main[i] == 0.0:
                main[i] = tiny
            f = lower[i] / main[i]
            main[i + 1] -= f * upper[i]
            x[i + 1] -= f * x[i]
    for i in range(d - 1, -1, -1):
        if abs(main[i]) < tiny:
            main[i] = np.copysign(tiny, main[i])
        x[i] -= upper[i] * x[i + 1] if i + 1 < d else 0.0
        x[i] -= second[i] * x[i + 2] if i + 2 < d else 0.0
        x[i] /= main[i]
        if abs(x[i]) > 1e200:
            x /= 1e200
    return x


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors (columns) of falling eigenvalues of a tridiagonal matrix, by inverse iteration.

    A vector is made orthogonal to those before it in its cluster after each step.
    """
    d = len(diagonal)
    norm = max(np.abs(diagonal).max() + (2 * np.abs(off).max() if len(off) else 0.0), 1e-300)
    rng = np.random.default_rng(d)
    out = np.zeros((d, len(values)))
    first, shift = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        shift = min(value, shift - 4 * _EPS * norm) if j > first else value  # equal values get shifts of their own
        x = rng.normal(size=d)
        for _ in range(6):
            x = _solve(diagonal, off, shift, x / np.abs(x).max(), _EPS * norm)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
            x /= np.sqrt(x @ x)
        out[:, j] = x
    return out


def principal_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the ``k`` leading components."""
    scale = np.abs(v).max() if v.size else 0.0
    if not scale > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    diagonal, off, reflections = tridiagonal(v / scale)
    values = leading_eigenvalues(diagonal, off, min(k, len(v)))
    values = values[values > len(v) * _EPS * values[0]]
    vectors = eigenvectors(diagonal, off, values)
    for first, u in reversed(reflections):
        vectors[first:] -= 2.0 * np.outer(u, u @ vectors[first:])
    return values * scale, vectors


# ------------------------------------------------------------ on tables

@dataclass(frozen=True)
class Whitening:
    """What a fit holds: its size is the dimension's, not the table's."""

    n: int  # different vectors
    sums: tuple[int, ...]  # S, per dimension
    values: np.ndarray
    vectors: np.ndarray  # one column per component
    explained: np.ndarray
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of integer vectors, one row each."""
        whole, rest = _mean(self.sums, self.n)
        return ((x - whole) - rest) @ (self.vectors / np.sqrt(self.values))


def _mean(sums, n: int) -> tuple[np.ndarray, np.ndarray]:
    """S / n as the nearest integers and what is left, computed in whole numbers."""
    whole = [(2 * s + n) // (2 * n) for s in sums]
    return np.array(whole, np.int64), np.array([(s - n * w) / n for s, w in zip(sums, whole)])


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    c = F.col("embedding").cast("array<double>")
    finite = F.forall(c, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    x = F.transform(c, lambda e: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), e)) * SCALE) + SHIFT)
    rows = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == most[0].d) if most else rows.limit(0)


def _matrix(column) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(array), -1)


def _upper_sums(rows: DataFrame, to_matrix) -> dict[tuple[int, int], float]:
    """Sums of the products of the columns of ``to_matrix(x)``, upper half, over all rows.

    One row per entry and task is shuffled; what comes to the driver is one matrix."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                y = to_matrix(_matrix(batch.column(0).slice(at, BLOCK_ROWS)))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    parts = rows.mapInArrow(partial, "i int, j int, v double")
    return {(r.i, r.j): r.v for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}


def _symmetric(entries: dict[tuple[int, int], float], d: int) -> np.ndarray:
    out = np.zeros((d, d))
    for (i, j), v in entries.items():
        out[i, j] = out[j, i] = v
    return out


def _column_sums(rows: DataFrame, d: int) -> tuple[int, ...]:
    """Exact sums of the dimensions, in whole numbers of any size; the upper and lower
    halves of the entries are summed apart, so nothing overflows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0))
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(high), pa.array(low)], ["i", "high", "low"])

    parts = rows.mapInArrow(partial, "i int, high long, low long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
    by = {r.i: (int(r.high) << 32) + int(r.low) for r in parts.groupBy("i").agg(whole("high"), whole("low")).collect()}
    return tuple(by[i] for i in range(d))


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of (…, x): None where no component varies."""
    different = stored(x.select("x").distinct(), "whitening-fit")
    n = different.count()
    if n < 2:
        return None
    d = different.select(F.size("x").alias("d")).first().d
    sums = _column_sums(different, d)
    whole, rest = _mean(sums, n)
    v = _symmetric(_upper_sums(different, lambda m: (m - whole).astype(float)), d) / n - np.outer(rest, rest)
    values, vectors = principal_components(v, components)
    if not len(values):
        return None
    found = Whitening(n, sums, values, vectors, values / np.trace(v))
    # measured on the whitened rows; they are centred already
    error = _symmetric(_upper_sums(different, found.project), len(values)) / n - np.eye(len(values))
    return Whitening(n, sums, values, vectors, found.explained, float(np.abs(error).max()))


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sum of (n * x - S)**2 per row; null where it is too large for a long."""
    z = n * x.astype(float) - sums
    size = (z * z).sum(1)
    fits = (size < 2.0**62) & (np.abs(x).max(1) * float(n) < 2.0**62)
    exact = n * np.where(fits[:, None], x, 0) - np.where(fits[:, None], sums.astype(np.int64), 0)
    return pa.array((exact * exact).sum(1), pa.int64(), mask=~fits)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = stored(integer_vectors(embeddings), "whitening-vectors")
    model = fit(x, components)
    if model is None:
        return x.sparkSession.createDataFrame([], schema)
    k, sums = len(model.values), np.array([float(s) for s in model.sums])
    if max(abs(s) for s in model.sums) < 1 << 62:
        sums = np.array(model.sums, np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                m, count = _matrix(part.column(1)), part.num_rows
                row = np.repeat(np.arange(count), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                        pa.array(np.full(count * k, model.n)), _deviation(m, model.n, sums).take(pa.array(row)),
                        pa.array(model.project(m).ravel()), pa.array(np.tile(model.explained, count)),
                        pa.array(np.full(count * k, model.identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return x.mapInArrow(rows, schema)
