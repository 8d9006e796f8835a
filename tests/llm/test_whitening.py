"""Whitening against a plain eigendecomposition, exact sums and odd rows."""

import math

import numpy as np
import pytest
from tidewell.llm import whitening as W


def plain(rows, k=8):
    """{(row, component): ...} by the covariance matrix, of Python's numbers."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    dev = [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x]
    c = np.array([[(n * r[j] - sums[j]) / n for j in range(d)] for r in x], float)
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, dev, c @ v / np.sqrt(e), e / np.trace(c.T @ c / n)


def test_against_eigenvectors(spark):
    rng = np.random.default_rng(3)
    rows = (rng.normal(size=(700, 12)) * np.linspace(3, 0.2, 12) + 5).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist(), "x") for i, r in enumerate(rows)], "vec_id long, embedding array<float>, deviation string").repartition(13)
    out = W.whitening(df).collect()
    n, dev, w, explained = plain(rows.astype(float).tolist())
    assert len(out) == 700 * 8
    signs = {}
    for r in out:
        k = r.component - 1
        assert (r.n, r.deviation) == (n, dev[r.vec_id]) and r.explained == pytest.approx(explained[k], rel=1e-9) and r.identity_error < 1e-9
        s = signs.setdefault(k, np.sign(r.whitened * w[r.vec_id, k]))
        assert r.whitened == pytest.approx(s * w[r.vec_id, k], abs=1e-7)


def test_query_on_given_vectors(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    n, dev, w, explained = plain([r.embedding for r in t])
    at = {r.vec_id: i for i, r in enumerate(t)}
    out = W.op12_whitening(spark, sf).collect()
    assert len(out) == 8 * n == 8 * len(at)
    signs = {}
    for r in out:
        i, k = at[r.vec_id], r.component - 1
        s = signs.setdefault(k, np.sign(r.whitened * w[i, k]))
        assert r.deviation == dev[i] and abs(r.whitened - s * w[i, k]) < 1e-6 and abs(r.explained / explained[k] - 1) < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (2, [1.0, 0.5]), (None, [2.0, 3.0]), (2, [1.0, 0.5]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (8, [1.0]), (9, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = W.whitening(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in out) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2)] and {r.n for r in out} == {4}
    assert W.whitening(df.where("vec_id = 3")).count() == 0  # nothing counts
    assert W.whitening(df.where("vec_id = 2")).count() == 0  # no variance
    assert W.whitening(df.where("vec_id > 9")).count() == 0
    # of two dimensions one is constant: one component
    flat = spark.createDataFrame([(i, [float(i), 7.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r.component for r in W.whitening(flat).collect()} == {1}


def test_large_numbers_are_exact():
    x = np.array([[2**60, 5], [2**60 - 3, -7], [-(2**60), 1]])
    assert W.exact_sum(x) == [2**60 - 3, -1]
    c = W.centred(x, 30, (2**60 - 3, -1))
    assert c.dtype == object and c[0, 0] == 30 * 2**60 - (2**60 - 3) and W.deviations(c) == [None] * 3
