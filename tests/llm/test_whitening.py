"""Whitening against direct integer sums, with vectors that do not count and odd columns."""

import math

import numpy as np
import pytest

from ratelens.llm.whitening import COMPONENTS, cross_products, whiten

SCHEMA = "vec_id long, embedding array<double>, component string, `a.b` int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(vectors)], SCHEMA)


def exact_table(vectors):
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    s = [sum(r[d] for r in x) for d in range(dims)]
    cov = np.array([[(n * sum(r[i] * r[j] for r in x) - s[i] * s[j]) / (n * n) for j in range(dims)] for i in range(dims)])
    return x, n, s, cov


@pytest.mark.parametrize("spread", [1, 2**20, 2**41])
def test_cross_products_equal_the_sums_at_every_width(spread):
    x = np.random.default_rng(3).integers(-spread, spread + 1, (131, 5))
    want = x.T.astype(object) @ x.astype(object)
    assert (cross_products(x) == np.triu(want)).all()


@pytest.mark.parametrize("dims", [3, 12])
def test_coordinates_are_white_and_deviations_exact(spark, dims):
    rng = np.random.default_rng(dims)
    mix = rng.normal(size=(dims, dims))
    good = (rng.normal(size=(300, dims)) @ mix - 120).tolist()
    good += [good[0]] * 5
    bad = [None, [], [None] * dims, [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), [1e300] * dims, [1.0] * (dims + 1)]
    rows = whiten(frame(spark, good + bad)).collect()
    x, n, s, cov = exact_table(good)
    k = min(dims, COMPONENTS)
    assert sorted((r.vec_id, r.component) for r in rows) == [(i, c + 1) for i in range(n) for c in range(k)]
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    for r in rows:
        assert r.n == n
        assert r.deviation == sum((n * a - b) ** 2 for a, b in zip(x[r.vec_id], s, strict=True))
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-9)
        assert r.identity_error < 1e-9
    z = np.zeros((n, k))
    for r in rows:
        z[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(np.cov(z.T, bias=True) - np.eye(k)).max() < 1e-9
    centred = np.array([[a - b / n for a, b in zip(v, s, strict=True)] for v in x])
    assert np.abs(np.linalg.lstsq(centred, z, rcond=None)[0].T @ cov @ np.linalg.lstsq(centred, z, rcond=None)[0] - np.eye(k)).max() < 1e-6


def test_no_variance_one_row_and_no_rows(spark):
    flat = whiten(frame(spark, [[1.0, 2.0]] * 4)).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in flat] == [(0, None, 0.0, None)] * 8
    line = whiten(frame(spark, [[float(i), 0.0] for i in range(4)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line)
    assert max(r.identity_error for r in line) < 1e-12
    assert whiten(frame(spark, [[1.0, 2.0]])).count() == 2
    for empty in ([], [None, []]):
        got = whiten(frame(spark, empty))
        assert got.count() == 0 and got.columns[:2] == ["vec_id", "component"]
    huge = whiten(frame(spark, [[2.0**41], [-(2.0**41)], [0.0]])).collect()
    assert {r.vec_id: r.deviation for r in huge} == {0: None, 1: None, 2: 0}
