"""Whitened embeddings against a plain eigenvalue decomposition."""

import math

import numpy as np
import pytest

from ledgerframe.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, component int, ids string, data string, label int"


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", "x", 3) for i, v in rows], SCHEMA)


def whole(vectors):
    return np.floor(1024 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 100_000


def check(spark, rows, kept, count=8, tolerance=1e-9):
    """The result for the rows, of which ``kept`` remain, compared with plain numpy; returns it."""
    got = whitening.whitened(frame_of(spark, rows).repartition(3), count).collect()
    x = whole([v for _, v in kept])
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    width = min(count, int((values > 1e-9 * max(values[0], 1)).sum()))
    assert len(got) == n * width
    deviations = sorted(sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x)
    for k in range(1, width + 1):
        rows_k = [r for r in got if r.component == k]
        assert sorted(r.vec_id or -1 for r in rows_k) == sorted(i or -1 for i, _ in kept)
        assert sorted(r.deviation for r in rows_k) == deviations
        assert {r.n for r in rows_k} == {n}
        assert all(math.isclose(r.explained, values[k - 1] / values.sum(), rel_tol=1e-9) for r in rows_k)
        gaps = np.abs(np.delete(values, k - 1) - values[k - 1])
        if gaps.min(initial=np.inf) > 1e-6 * values[0]:
            want = np.sort(centred @ axes[:, k - 1] / np.sqrt(values[k - 1]))
            found = np.sort([r.whitened for r in rows_k])
            assert min(np.abs(found - want).max(), np.abs(found + want[::-1]).max()) < tolerance
    errors = {r.identity_error for r in got}
    assert len(errors) <= 1 and max(errors, default=0) < 1e-9
    return got


def test_rows_that_do_not_count_and_rows_that_repeat(spark):
    rng = np.random.default_rng(1)
    good = [(i, (rng.standard_normal(12) * np.arange(1, 13)).tolist()) for i in range(60)]
    good += [good[0], good[1], (None, good[2][1]), (7, good[3][1])]
    bad = [(100, None), (101, [None, *good[0][1][1:]]), (102, [float("nan"), *good[0][1][1:]]), (103, [float("-inf"), *good[0][1][1:]])]
    bad += [(104, []), (105, [1.0, 2.0]), (106, [1.0] * 13)]
    check(spark, good + bad, good)


@pytest.mark.parametrize("kind", ["flat", "few directions", "equal", "two points", "steep", "one dimension"])
def test_shapes(spark, kind):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 10))
    if kind == "few directions":
        base = np.round(base[:, :3] * 4) @ rng.integers(-3, 4, (3, 10)) / 4
    elif kind == "equal":
        # four axes of equal variance beyond any doubt, from both ends of each
        base = np.vstack([np.eye(10)[:4], -np.eye(10)[:4]] * 3) * 5
    elif kind == "two points":
        base = np.vstack([np.ones((7, 10)), np.zeros((3, 10))])
    elif kind == "steep":
        base = base * 4.0 ** -np.arange(10) * 50
    elif kind == "one dimension":
        base = base[:, :1]
    rows = [(i, v) for i, v in enumerate(base.tolist())]
    check(spark, rows, rows, tolerance=1e-6)


def test_equal_variances_are_all_found():
    # the matrix is never built from one start: equal eigenvalues need fresh ones
    x = np.vstack([np.eye(30)[:9], -np.eye(30)[:9]]) * 3.0

    def products(w):
        u = x @ w
        return x.T @ u, float(u @ u)

    found = whitening.bidiagonalised(products, 30, 8, float((x**2).sum()), len(x), np.zeros(30, np.int64))
    assert np.allclose(found.variances, 18 / 18) and np.allclose(found.axes.T @ found.axes, np.eye(8))


def test_wide_vectors_need_fewer_steps_than_dimensions():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((500, 200)) * 0.7 ** np.arange(200)

    def products(w):
        u = x @ w
        return x.T @ u, float(u @ u)

    found = whitening.bidiagonalised(products, 200, 8, float((x**2).sum()), len(x), np.zeros(200, np.int64))
    s = np.linalg.svd(x, compute_uv=False)[:8]
    assert found.steps < 100 and np.allclose(found.variances, s**2 / len(x), rtol=1e-12)


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(0, [3e6, 0.0]), (1, [-3e6, 0.0]), (2, [0.5, 1.0])]
    x = whole([v for _, v in rows])
    want = [sum((3 * int(c) - int(s)) ** 2 for c, s in zip(r, x.sum(axis=0), strict=True)) for r in x]
    got = {r.vec_id: r.deviation for r in whitening.whitened(frame_of(spark, rows), 1).collect()}
    assert got == {i: w if w < 2**63 else None for i, w in enumerate(want)} and None in got.values()
    assert whitening.whitened(frame_of(spark, [(0, [3e38, 1.0]), (1, [1.0, 1.0])]), 1).count() == 2


def test_no_rows(spark):
    assert whitening.whitened(frame_of(spark, [])).collect() == []
    assert whitening.whitened(frame_of(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whitened(frame_of(spark, [(1, [1.0, 2.0])])).collect() == []
