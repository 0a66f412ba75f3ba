"""Whitening against numpy's eigenvectors, the divide and conquer on hard spectra, and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import whitening
from labelloom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=4, scale=256):
    """vec_id -> (n, deviation, whitened up to signs, explained), by numpy's eigh."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(v) for _, v in kept)
    xs = [[math.floor(float(np.float32(c)) * scale) for c in v] + [0] * (d - len(v)) for _, v in kept]
    fit = np.array(sorted(set(map(tuple, xs))), np.int64)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return [(i, n, sum((n * a - int(b)) ** 2 for a, b in zip(x, s, strict=True)), (np.array(x) - s / n) @ q / np.sqrt(e), e / np.trace(c.T @ c / n)) for (i, _), x in zip(kept, xs, strict=True)]


def compare(df, rows, k=4):
    want = plain(rows, k)
    got = {}
    for r in df.collect():
        got.setdefault(r.vec_id, []).append(r)
        assert r.identity_error <= 1e-9
    assert sum(map(len, got.values())) == len(want) * k
    signs = None
    for i, n, deviation, w, explained in want:
        mine = {r.component: r for r in got[i]}
        assert {r.n for r in got[i]} == {n} and {r.deviation for r in got[i]} == {deviation}
        y = np.array([mine[c + 1].whitened for c in range(k)])
        if signs is None:
            signs = np.sign(y * w)
        assert np.allclose(y, w * signs, rtol=1e-7, atol=1e-9)
        assert np.allclose([mine[c + 1].explained for c in range(k)], explained, rtol=1e-10)


def test_query_equals_eigh(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    compare(QUERIES["op12_embedding_whitening"](spark, sf_dir), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(80)]
    rows += [(100, None), (101, [None] * 6), (102, [math.nan] + [0.0] * 5), (103, [math.inf] * 6), (104, [0.5, -0.25]), (105, [])]
    rows += [(200 + i, rows[3][1]) for i in range(50)]  # copies count once in the fit
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({"x": F.lit("a"), "n": F.lit("b"), "v": F.lit("c"), "component": F.lit("d")})
    compare(whitening.whiten(df), rows)


def test_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0]), (2, [3.0, 5.0])]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in out) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_components_without_variance_are_left_out(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 9 and {r.component for r in out} == {1} and abs(out[0].explained - 1) < 1e-12


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(np.random.default_rng(4).integers(-(10**5), 10**5, (40, 3)))]
    compare(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), [(i, [np.float64(c) for c in v]) for i, v in rows], 3)
    huge = [(i, [3e38 * (i % 2), 1.0 * i]) for i in range(6)]
    out = whitening.whiten(spark.createDataFrame(huge, SCHEMA)).collect()
    assert out and all(r.deviation is None for r in out)


SPECTRA = {
    "spread": lambda d: np.sort(np.random.default_rng(1).random(d))[::-1] * 100,
    "one large": lambda d: np.array([1000.0] + [1.0] * (d - 1)),
    "equal": lambda d: np.full(d, 5.0),
    "falling": lambda d: 1e4 * 10.0 ** -np.linspace(0, 12, d),
    "groups": lambda d: np.concatenate([np.repeat([9.0, 8.0, 7.0], d)[: max(1, d // 2)], np.zeros(d - max(1, d // 2))]),
    "symmetric": lambda d: np.linspace(-1, 1, d)[::-1].copy(),
}


@pytest.mark.parametrize("kind", SPECTRA)
@pytest.mark.parametrize("d", [1, 2, 5, 40])
def test_divide_and_conquer(d, kind):
    q, _ = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    v = (q * SPECTRA[kind](d)) @ q.T
    v = (v + v.T) / 2
    e, w = whitening.components(v, min(4, d))
    scale = np.linalg.norm(v) or 1.0
    assert np.allclose(e, np.sort(np.linalg.eigvalsh(v))[::-1][: len(e)], atol=1e-13 * scale)
    assert np.allclose(w.T @ w, np.eye(len(e)), atol=1e-13) and np.linalg.norm(v @ w - w * e) <= 1e-13 * scale * d


def test_polar_factor():
    a = np.diag([3.0, 1e-9, -2.0, -1e-6])
    assert np.allclose(whitening.polar(a), np.diag([1.0, 1.0, -1.0, -1.0]), atol=1e-12)
