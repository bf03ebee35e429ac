"""Whitening against numpy's eigenvectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>"


def expected(rows):
    usable = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(x) for _, x in usable), default=0)
    usable = [(i, x + [0] * (d - len(x))) for i, x in usable]
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array([[n * a - s for a, s in zip(x, sums)] for x in fit], object).astype(float) / n
    values, axes = np.linalg.eigh(z.T @ z / n)
    return usable, n, sums, values[::-1], axes[:, ::-1]


def check(frame, rows, most=4, loose=1e-8):
    got = whitening.whiten_embeddings(frame(rows, SCHEMA).repartition(5), ["vec_id"]).collect()
    usable, n, sums, values, axes = expected(rows)
    k = min(most, int((values > 1e-9 * max(values.max(), 1e-300)).sum()))
    assert len(got) == k * len(usable)
    table = {}
    for r in got:
        table.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for i, x in usable:
        y = [n * a - s for a, s in zip(x, sums)]
        for c in range(k):
            r = table[i, c + 1][0]
            assert (r.n, r.deviation) == (n, sum(v * v for v in y))
            assert r.explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
            assert r.identity_error < 1e-9
            want = float(np.array(y, float) / n @ axes[:, c] / math.sqrt(values[c]))
            if abs(want) > 1e-3:
                sign = signs.setdefault(c, math.copysign(1, want * r.whitened))
                assert r.whitened * sign == pytest.approx(want, abs=loose)
    return got


def test_random_vectors(frame):
    draw = np.random.default_rng(3)
    scale = 2.0 ** -np.arange(12)
    rows = [(i, (draw.normal(size=12) * scale).tolist()) for i in range(200)]
    rows += [(500 + i, rows[0][1]) for i in range(100)] + [(7, rows[7][1])]  # copies count once in the fit
    rows += [(900, None), (901, [None] + [0.0] * 11), (902, [math.nan] * 12), (903, [math.inf] + [0.0] * 11)]
    check(frame, rows)


def test_large_offset_keeps_small_spread(frame):
    draw = np.random.default_rng(4)
    rows = [(i, (np.array([60000.0, -60000.0, 3.0]) + draw.integers(-3, 4, 3) * [1, 2, 0.25] / 64).tolist()) for i in range(60)]
    check(frame, rows)


def test_dependent_and_short_vectors(frame):
    draw = np.random.default_rng(5)
    rows = [(i, [a, a, -a, 2 * a]) for i, a in enumerate(draw.integers(-9, 9, 20).astype(float).tolist())]
    assert {r.component for r in check(frame, rows)} == {1}
    check(frame, [*[(i, draw.normal(size=4).tolist()) for i in range(30)], (99, [1.0]), (98, [])])


def test_nothing_to_whiten(frame):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, [])]):
        assert whitening.whiten_embeddings(frame(rows, SCHEMA), ["vec_id"]).collect() == []


def test_clashing_names_and_a_deviation_beyond_a_long(frame):
    rows = frame([(i, [v]) for i, v in enumerate([0.0, 1e15, 3e15])], SCHEMA).withColumn("n", F.lit("mine")).withColumn("x", F.lit(2))
    out = whitening.whiten_embeddings(rows, ["vec_id", "n", "x"])
    assert out.columns == ["vec_id", "n", "x", "component", "_n", "deviation", "whitened", "explained", "identity_error"]
    assert {(r.n, r._n, r.deviation) for r in out.collect()} == {("mine", 3, None)}


def test_factor_and_rotation():
    draw = np.random.default_rng(6)
    for d, r in ((1, 1), (2, 2), (7, 7), (9, 4), (40, 40)):
        a = draw.normal(size=(d, r)) * 0.8 ** np.arange(r)
        a = a @ a.T
        factor = whitening.pivoted_cholesky(a)
        assert factor.shape == (d, r) and np.allclose(factor @ factor.T, a, atol=1e-13 * np.trace(a))
        values, axes = whitening.jacobi(factor)
        assert np.allclose(axes.T @ axes, np.eye(r), atol=1e-12) and np.allclose(a @ axes, axes * values, atol=1e-13 * np.trace(a))
        assert (np.diff(values) <= 0).all()
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)
