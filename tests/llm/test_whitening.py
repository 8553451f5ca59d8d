"""Whitening against a dense eigendecomposition."""

import numpy as np
import pytest

from turfspark.llm import whitening

SCHEMA = "component string, vec_id long, embedding array<float>, n int"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [("x", i, None if v is None else [None if c is None else float(c) for c in v], 3) for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def dense(vectors, k):
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    c = (n * x - sums) / n
    values, basis = np.linalg.eigh(c.T @ c / n)
    values, basis = values[::-1], basis[:, ::-1]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return n, deviation, c @ basis[:, :k], values, values[:k] / values.sum()


def check(rows, vectors, k):
    n, deviation, projected, values, explained = dense(vectors, k)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(got) == n * k
    for c in range(k):
        column = np.array([got[i, c + 1].whitened for i in range(n)])
        want = projected[:, c] / np.sqrt(values[c])
        assert np.allclose(column * np.sign(column @ want), want, atol=1e-8)
    assert all(r.n == n and r.deviation == deviation[r.vec_id] for r in rows)
    assert all(abs(r.explained / explained[r.component - 1] - 1) < 1e-9 for r in rows)
    assert max(r.identity_error for r in rows) < 1e-9


@pytest.mark.parametrize("d, n", [(40, 3000), (5, 400), (48, 120)])
def test_against_dense(spark, d, n):
    rng = np.random.default_rng(d)
    vectors = rng.normal(size=(n, d)) * np.linspace(3, 0.3, d) @ np.linalg.qr(rng.normal(size=(d, d)))[0] + 5
    vectors[: n // 3] = vectors[0]  # a third of the rows are one vector
    rows = whitening.whitened(frame(spark, vectors).repartition(40, "vec_id")).collect()
    check(rows, vectors, min(d, 32))


def test_nulls_repeats_and_extra_columns(spark):
    rng = np.random.default_rng(1)
    good = rng.normal(size=(60, 6))
    bad = [None, [], [1, None, 0, 0, 0, 0], [1, float("nan"), 0, 0, 0, 0], [1, float("inf"), 0, 0, 0, 0]]
    rows = whitening.whitened(frame(spark, [*good, *bad])).collect()
    check(rows, good, 6)
    again = whitening.whitened(frame(spark, [*good, *good], [None] * 60 + [7] * 60)).collect()
    assert len(again) == 120 * 6 and sum(r.vec_id is None for r in again) == 360


def test_components_without_variance(spark):
    rng = np.random.default_rng(2)
    flat = rng.normal(size=(50, 2)) @ rng.integers(-3, 4, size=(2, 5)) * 0 + np.round(rng.normal(size=(50, 1)) * 64) / 64 * [1, 2, 0, 0, 1]
    rows = whitening.whitened(frame(spark, flat)).collect()
    assert {r.component for r in rows if r.whitened is not None} == {1}
    assert max(r.identity_error for r in rows) < 1e-9
    one = whitening.whitened(frame(spark, [[1.0, 2.0]])).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(0, None, 0.0, 0.0)] * 2
    assert whitening.whitened(frame(spark, [])).count() == 0
    assert whitening.whitened(frame(spark, [None, []])).count() == 0


def test_ties_and_size(spark):
    """Equal eigenvalues; a deviation that a long can't hold is an error, and so are mixed lengths."""
    corners = [[s * (i == j) for j in range(4)] for i in range(4) for s in (1, -1)]
    rows = whitening.whitened(frame(spark, corners)).collect()
    assert max(r.identity_error for r in rows) < 1e-12 and {round(r.explained, 12) for r in rows} == {0.25}
    with pytest.raises(Exception, match="doesn't fit a long"):
        whitening.whitened(frame(spark, [[1e9], [-1e9], [0.0]])).collect()
    with pytest.raises(Exception, match="different lengths"):
        whitening.whitened(frame(spark, [[1.0], [1.0, 2.0]])).collect()


def test_updates_stay_orthonormal():
    rng = np.random.default_rng(3)
    for kind in range(4):
        for _ in range(20):
            d = int(rng.integers(1, 30))
            a = rng.normal(size=(int(rng.integers(1, 50)), d))
            a = [a, np.round(a), a * (np.arange(d) < d / 2), a * 10.0 ** rng.integers(-6, 6, size=d)][kind]
            values, vectors = np.zeros(d), np.eye(d)
            for row in a:
                values, vectors = whitening.update(values, vectors, row)
            want = a.T @ a
            assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12
            assert np.abs(vectors @ np.diag(values) @ vectors.T - want).max() <= 1e-12 * np.abs(want).max()
