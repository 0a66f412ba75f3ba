"""Embedding whitening by spectral divide and conquer of the covariance.

Entries become integers, x = floor(SCALE * c). The vectors that the covariance is fitted
to are the distinct ones. Tasks add up their vectors, then the products of their
centred vectors, row by row; the sums of all tasks are added by row number, so what
reaches the driver is d numbers and a matrix of d x d, whatever the number of vectors.

There the symmetric polar factor U of V - mu I, by dynamically weighted Halley steps on
QR factors (QDWH), gives the spectral projector (U + I) / 2 of all eigenvalues above
mu, the mean of those at hand. An orthonormal basis of its range and of the rest splits V
into two blocks; the upper is split first, and again, until a block is one component (or a
multiple of the identity, whose every direction is one), so the components come by
falling eigenvalue and only as many are computed as are asked for. Mean, vectors and
eigenvalues (d x k numbers, d at most MOST_DIMENSIONS) are sent to the tasks that
whiten every row.

Defined results: a null vector, or one with null, NaN or infinite entries, is left out;
other columns are not read; repeated rows, and rows of a null vec_id, are whitened each;
vectors of fewer entries than the longest get zeros at their end; components without
variance (by EMPTY of the trace) are left out, so fewer distinct vectors, or dimensions,
than components give fewer rows, and none at all if no vector differs; an entry beyond a
long is held at its end, and a deviation beyond a long is null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import stored, table

SCALE, COMPONENTS = 256, 4
MOST_DIMENSIONS = 8192
EMPTY = 1e-12
_LONG = 2**62


def integers(rows: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """vec_id and x of the rows whose vector is whole."""
    known = rows.select(F.col("vec_id").cast("long"), F.col(vector).alias("v")).filter(F.col("v").isNotNull())
    known = known.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return known.select("vec_id", F.transform("v", lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column as rows of d integers, short ones filled with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if (ends == d).all():
        return flat.reshape(len(ends), d)
    out = np.zeros((len(ends), d), np.int64)
    out[np.repeat(np.arange(len(ends)), ends), np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


def _sums(d: int):
    """For each dimension the sum of a task's entries, exact, as text, and the largest magnitude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, most = [0] * d, 0
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), d)
                top = max(int(x.max()), -int(x.min()))
                part = x.sum(axis=0) if top * len(x) < _LONG else x.astype(object).sum(axis=0)
                total, most = [s + int(p) for s, p in zip(total, part, strict=True)], max(most, top)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(map(str, total), pa.string()), pa.array([float(most)] * d)], names=["i", "s", "most"])

    return run


class Mean:
    """Number n of fitted vectors, their exact sums, and n * x - sum, in longs where these hold it."""

    def __init__(self, n: int, sums: list[int], most: float):
        self.n, self.sums = n, sums
        self.exact = np.array(sums, object)
        self.wide = n * most >= _LONG
        self.large = (2 * n * most) ** 2 * len(sums) >= _LONG

    def shifted(self, x: np.ndarray) -> np.ndarray:
        return x.astype(object) * self.n - self.exact if self.wide else x * self.n - self.exact.astype(np.int64)

    def centred(self, shifted: np.ndarray) -> np.ndarray:
        return (shifted / self.n).astype(np.float64)

    def squares(self, shifted: np.ndarray) -> pa.Array:
        wide = shifted.astype(object) if self.large else shifted
        return pa.array([int(v) if v < 2**63 else None for v in (wide * wide).sum(axis=1).tolist()], pa.int64())


def _products(mean: Mean, d: int):
    """The rows of a task's sum of products of centred vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((d, d)), False
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                c = mean.centred(mean.shifted(_matrix(b.column(0).slice(at, 1024), d)))
                total += c.T @ c
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors of each row number; all of a number are in one task."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            row = v.values.to_numpy()
            held[i] = held[i] + row if i in held else row
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["i", "v"])


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix, by QR-based dynamically weighted Halley steps."""
    n = len(a)
    x, one = a / np.linalg.norm(a), np.eye(n)
    low = np.finfo(float).eps / n  # a lower bound of the least singular value that matters
    for _ in range(40):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        p = np.sqrt(1 + d) + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d))) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        f, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, one]))
        y = q / r * x + (p - q / r) / np.sqrt(r) * (f[:n] @ f[n:].T)
        y = (y + y.T) / 2
        change, x = np.linalg.norm(y - x), y
        low = min(1.0, low * (p + q * square) / (1 + r * square))
        if change <= np.cbrt(4 * np.finfo(float).eps) and 1 - low <= 10 * np.finfo(float).eps:  # convergence is cubic
            break
    return x


#: Where a block is cut, about its mean, in shares of the spread: further ones if an eigenvalue is too near to the first.
_SHIFTS = (0.0, 0.0317, -0.0523, 0.1009, -0.1511, 0.2103, -0.2711)


def _halves(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the invariant subspaces above and below a shift."""
    n, mu = len(v), np.trace(v) / len(v)
    spread = np.linalg.norm(v - mu * np.eye(n)) / np.sqrt(n)
    best = None
    for share in _SHIFTS:
        u = polar(v - (mu + share * spread) * np.eye(n))
        r = round((np.trace(u) + n) / 2)
        if not 0 < r < n:
            continue
        p = (u + np.eye(n)) / 2
        mix = np.random.default_rng(7).standard_normal((n, n))
        basis, _ = np.linalg.qr(np.hstack([p @ mix[:, :r], mix[:, r:] - p @ mix[:, r:]]))
        basis, _ = np.linalg.qr(np.hstack([p @ basis[:, :r], basis[:, r:] - p @ basis[:, r:]]))
        above, below = basis[:, :r], basis[:, r:]
        left = np.linalg.norm(below.T @ v @ above)
        if best is None or left < best[0]:
            best = left, above, below
        if left <= 1e-14 * n * np.linalg.norm(v):
            break
    if best is None:  # the eigenvalues are as good as equal
        return np.eye(n)[:, :1], np.eye(n)[:, 1:]
    return best[1], best[2]


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their vectors as columns."""
    norm, found, stack = np.linalg.norm(v), [], [np.eye(len(v))]
    while stack and len(found) < k:
        basis = stack.pop()
        own = basis.T @ v @ basis
        own = (own + own.T) / 2
        n = len(own)
        if n == 1 or np.linalg.norm(own - np.trace(own) / n * np.eye(n)) <= 4e-16 * np.sqrt(len(v)) * norm:
            found.extend(basis.T)
            continue
        above, below = _halves(own)
        stack += [basis @ below, basis @ above]
    vectors = np.array(found[:k]).T
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


class Whitener:
    """What every task needs: mean, components scaled to unit variance, and explained shares."""

    def __init__(self, mean: Mean, d: int, values: np.ndarray, vectors: np.ndarray, trace: float):
        keep = values > EMPTY * trace
        self.mean, self.d = mean, d
        self.scaled = vectors[:, keep] / np.sqrt(values[keep])
        self.explained = values[keep] / trace
        self.k = int(keep.sum())

    def whitened(self, x: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        shifted = self.mean.shifted(x)
        return self.mean.centred(shifted) @ self.scaled, self.mean.squares(shifted)


def _whiten(w: Whitener, wide: bool):
    """Rows (vec_id, x): a row for each component, or (wide) w0, w1, ... of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y, deviation = w.whitened(_matrix(b.column(1), w.d))
            if wide:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in y.T], names=[f"w{i}" for i in range(w.k)])
                continue
            each = pa.array(np.repeat(np.arange(b.num_rows), w.k))
            columns = [b.column(0).take(each), pa.array(np.tile(np.arange(1, w.k + 1, dtype=np.int32), b.num_rows)), deviation.take(each), pa.array(y.ravel()), pa.array(np.tile(w.explained, b.num_rows))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "deviation", "whitened", "explained"])

    return run


def fitted(fit: DataFrame, k: int = COMPONENTS) -> Whitener | None:
    """The whitening of distinct vectors x; None if they do not differ."""
    n, d = fit.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n or not d:
        return None
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} entries: a covariance of more than {MOST_DIMENSIONS} is not collected")
    s = fit.mapInArrow(_sums(d), "i int, s string, most double").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.max("most").alias("most")).orderBy("i").collect()  # d rows
    mean = Mean(n, [int(r["s"]) for r in s], s[0]["most"])
    rows = fit.mapInArrow(_products(mean, d), "i int, v array<double>").repartition("i").mapInArrow(_added, "i int, v array<double>").orderBy("i").collect()  # d rows of d
    v = np.array([r["v"] for r in rows]) / n
    v = (v + v.T) / 2
    trace = float(np.trace(v))
    return Whitener(mean, d, *components(v, min(k, d)), trace) if trace > 0 else None


WHITENED = "vec_id long, component int, deviation long, whitened double, explained double"


def whiten(rows: DataFrame, vector: str = "embedding", k: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row with a whole vector."""
    spark = rows.sparkSession
    x = integers(rows, vector, scale)
    fit = stored(x.select("x").distinct())
    w = fitted(fit, k)
    if w is None or not w.k:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    pairs = [(i, j) for i in range(w.k) for j in range(i, w.k)]
    wide = fit.select(F.lit(None).cast("long").alias("vec_id"), "x").mapInArrow(_whiten(w, True), ", ".join(f"w{i} double" for i in range(w.k)))
    own = wide.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
    error = max(abs(own[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    out = x.mapInArrow(_whiten(w, False), WHITENED)
    return out.select("vec_id", "component", F.lit(w.mean.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(float(error)).alias("identity_error"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
