import math

import numpy as np
import pytest
from mossgraph.llm import whitening
from pyspark.sql import functions as F


def fit(vectors):
    x = np.floor(1024 * np.array(vectors, float)).astype(int) + 100_000
    v = np.cov(x.T, bias=True).reshape(x.shape[1], -1)
    e, u = np.linalg.eigh(v)
    return x, v, e[::-1], u[:, ::-1]


@pytest.mark.parametrize("d", [1, 3, 12, 40])
def test_whitening(spark, d):
    r = np.random.default_rng(d)
    good = (r.standard_normal((300, d)) * np.linspace(2, 0.5, d)).astype(np.float32).tolist()
    good += good[:20]
    bad = [None, [None] * d, [float("nan")] * d, [1.0] * (d - 1) + [float("-inf")], [], [1.0] * (d + 1)]
    rows = [(i, v, "s", 1) for i, v in enumerate(good)] + [(1000 + i, v, "s", 1) for i, v in enumerate(bad)]
    got = whitening.per_component(spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, x int")).collect()
    x, v, e, u = fit(good)
    n, k = len(x), min(8, d)
    assert len(got) == n * k and {g.n for g in got} == {n}
    w = np.zeros((n, k))
    for g in got:
        w[g.vec_id, g.component - 1] = g.whitened
        assert g.deviation == g.deviation_exact == sum(int(a) ** 2 for a in n * x[g.vec_id] - x.sum(axis=0))
        assert math.isclose(g.explained, e[g.component - 1] / e.sum(), rel_tol=1e-9)
    z = (x - x.mean(axis=0)) @ u[:, :k] / np.sqrt(e[:k])
    assert np.abs(w * np.sign((w * z).sum(axis=0)) - z).max() < 1e-8
    assert {g.identity_error for g in got} == {got[0].identity_error} and got[0].identity_error < 1e-10


def test_whitening_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.per_component(spark.createDataFrame([], schema)).count() == 0
    assert whitening.per_component(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whitening.per_component(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0  # equal vectors have no components
    got = whitening.per_component(spark.createDataFrame([(None, [1.0, 2.0]), (2, [3.0, 2.0])], schema)).orderBy("whitened").collect()
    assert [(g.component, round(abs(g.whitened), 9), round(g.explained, 9)) for g in got] == [(1, 1.0, 1.0)] * 2 and got[0].deviation == 2048**2


def test_deviations_beyond_a_long(spark):
    got = whitening.per_component(spark.createDataFrame([(1, [3e6]), (2, [-3e6])], "vec_id long, embedding array<double>")).collect()
    assert {g.deviation_exact for g in got} == {(3 * 10**6 * 2048) ** 2} and all(g.deviation is None for g in got)


def matrix(d, values, seed=3):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    return q * np.array(values) @ q.T


@pytest.mark.parametrize(
    "values",
    [[1.0], [2.0, 1.0], np.ones(64), [5.0] * 10 + [1.0] * 54, [3.0, 2, 1] + [0.0] * 61, np.linspace(3, 1, 200), 0.97 ** np.arange(150), [9.0] * 3 + list(np.linspace(1.001, 1, 97))],
)
def test_jacobi_davidson(values):
    a = matrix(len(values), values)
    calls = []
    e, p = whitening.jacobi_davidson(lambda b: calls.append(b.shape) or a @ b, len(values), 8, float(np.trace(a)))
    k = min(8, len(values))
    assert np.allclose(e, sorted(values, reverse=True)[:k], atol=1e-12 * max(values))
    assert np.abs(a @ p - p * e).max() < 1e-12 * max(values) and np.abs(p.T @ p - np.eye(k)).max() < 1e-12
    assert all(shape[1] <= k + whitening.SPARE for shape in calls)


def test_products_are_sums_over_tasks(spark):
    rows = whitening.vectors_of(spark.range(100).select(F.col("id").alias("vec_id"), F.array(F.col("id") / 7, F.col("id") % 5 / 3, F.lit(1.0)).alias("embedding")))
    made = whitening.fitted(rows.repartition(7), 2)
    x, v, e, _ = fit([[i / 7, i % 5 / 3, 1.0] for i in range(100)])
    assert made.n == 100 and made.sums == x.sum(axis=0).tolist() and np.allclose(made.values, e[:2], rtol=1e-12) and math.isclose(made.trace, np.trace(v), rel_tol=1e-12)
