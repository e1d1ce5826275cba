"""Matrices summed in one scan against numpy: folds, shuffles, leverage, components, kernel regression."""

import numpy as np
import pytest

from alembiq.operators import grams as G
from alembiq.operators import kernel as K
from alembiq.operators import modelling as M
from pyspark.sql import functions as F


def table(spark, x, y, parts=5):
    rows = [(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x array<double>, y double").repartition(parts)


@pytest.mark.parametrize("tile, fan", [(256, 16), (3, 2)])
def test_matrices_by_group(spark, monkeypatch, tile, fan):
    monkeypatch.setattr(G, "TILE", tile)
    monkeypatch.setattr(G, "FAN", fan)
    monkeypatch.setattr(G, "BLOCK", 11)
    r = np.random.default_rng(1)
    x = r.normal(size=(203, 10)) + 1e6
    found = G.grams(table(spark, x, x[:, 0]), "x", F.col("id") % 3)
    assert sorted(found) == [0, 1, 2]
    for k, g in found.items():
        own = x[np.arange(203) % 3 == k]
        assert g.n == len(own) and np.allclose(g.covariance(), np.cov(own.T, bias=True), atol=1e-8)
    assert G.grams(table(spark, x, x[:, 0]).limit(0), "x") == {}


def columns(df, p):
    return df.select("id", "y", *[F.col("x")[i].alias(f"x{i}") for i in range(p)])


def test_folds_in_one_scan_equal_a_training_for_each(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 4)) * [1, 5, 0.1, 1] + [0, 100, 3, 0]
    x[:, 3] = 7
    y = x[:, 0] - 0.2 * x[:, 1] + 20 * x[:, 2] + r.normal(size=400)
    df = columns(table(spark, x, y), 4)
    got = {m["fold"]: m for m in G.cross_validate_linear(df, ["x0", "x1", "x2", "x3"], "y", "id").collect()}
    fold = {m["id"]: m["fold"] for m in M.folds(df, "id").collect()}
    at = np.array([fold[i] for i in range(400)])
    for k in range(5):
        a = np.hstack([np.ones((400, 1)), x[:, :3]])
        w = np.linalg.lstsq(a[at != k], y[at != k], rcond=None)[0]
        p, t = a[at == k] @ w, y[at == k]
        assert got[k]["n"] == (at == k).sum() and got[k]["rmse"] == pytest.approx(np.sqrt(np.mean((p - t) ** 2)), rel=1e-9)
        assert got[k]["r2"] == pytest.approx(1 - ((p - t) ** 2).sum() / ((t - t.mean()) ** 2).sum(), rel=1e-9)
        assert got[k]["pearson"] == pytest.approx(np.corrcoef(p, t)[0, 1], rel=1e-9)


def test_one_scan_whatever_the_folds(spark):
    df = columns(table(spark, np.random.default_rng(3).normal(size=(60, 2)), range(60)), 2)
    scans, old = [], G.grams
    G.grams = lambda *a, **k: scans.append(1) or old(*a, **k)
    try:
        assert G.cross_validate_linear(df, ["x0", "x1"], "y", "id", k=12).count() > 8
        assert len(scans) == 1
        assert G.shuffled_scores(df, ["x0", "x1"], "y", "id", n=7).count() == 8
        assert len(scans) == 2
    finally:
        G.grams = old


def test_missing_and_constant_values(spark):
    rows = spark.createDataFrame([(i, float(i), None if i % 5 == 0 else 3.0, float("nan") if i == 1 else 2.0) for i in range(50)], "id long, a double, y double, b double")
    got = G.cross_validate_linear(rows, ["a", "b"], "y", "id").collect()
    assert sum(m["n"] for m in got) == 39 and all(m["r2"] == 0 and m["pearson"] == 0 and m["rmse"] < 1e-9 for m in got)
    assert G.cross_validate_linear(rows.limit(0), ["a"], "y", "id").collect() == []
    assert G.shuffled_scores(rows.limit(0), ["a"], "y", "id").collect() == []


def test_shuffles_are_permutations_and_lose_the_signal(spark):
    for n in (1, 2, 30, 97, 360):
        for a, b in G.shuffles(n, 6):
            assert sorted((a * j + b) % n for j in range(n)) == list(range(n))
    r = np.random.default_rng(4)
    x = r.normal(size=(500, 3))
    y = x @ [1, 2, 3] + 0.1 * r.normal(size=500)
    got = {m["shuffle"]: m["r2"] for m in G.shuffled_scores(columns(table(spark, x, y), 3), ["x0", "x1", "x2"], "y", "id", 8).collect()}
    assert got[0] > 0.99 and len(got) == 9 and all(0 <= got[s] < 0.1 for s in range(1, 9))


@pytest.mark.parametrize("p, n", [(64, 300), (2048, 60)])
def test_leverage_of_wide_vectors(spark, p, n):
    r = np.random.default_rng(5)
    x = (r.random((n, p)) < 0.1).astype(float)
    df = table(spark, x, range(n), 3)
    got = {m["id"]: m for m in G.leverage(df, df.withColumn("leverage", F.lit("old")), "x").collect()}
    want = np.einsum("ij,jk,ik->i", x, np.linalg.pinv(x.T @ x, hermitian=True), x)
    assert [got[i]["leverage"] for i in range(n)] == pytest.approx(want, abs=1e-7)
    assert [got[i]["in_domain"] for i in range(n)] == [bool(h <= 3 * p / n) for h in want]
    nothing = G.leverage(df.limit(0), df, "x").first()
    assert nothing["leverage"] is None and nothing["in_domain"] is None


def test_components(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(200, 30)) * np.linspace(3, 0.1, 30) + 50
    mean, axes, variance = G.principal_axes(table(spark, x, range(200)), "x", 3)
    e, v = np.linalg.eigh(np.cov(x.T, bias=True))
    assert mean == pytest.approx(x.mean(axis=0)) and variance == pytest.approx(e[::-1][:3])
    assert np.abs(np.diag(axes.T @ v[:, ::-1][:, :3])) == pytest.approx(np.ones(3))


def test_kernel_regression_beats_a_line_and_agrees_with_the_exact_kernel(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(700, 5))
    y = np.sin(x[:, 0]) * 2 + x[:, 1] * x[:, 2] + 0.05 * r.normal(size=700)
    df, held = table(spark, x[:500], y[:500]), table(spark, x[500:], y[500:])
    model = K.KernelRegression.fit(df, "x", "y", features=1024, c=10.0, epsilon=0.1, passes=60)
    got = {m["id"]: m["p"] for m in model.predict(held, "x", "p").collect()}
    p, t = np.array([got[i] for i in range(200)]), y[500:]
    r2 = lambda p: 1 - ((p - t) ** 2).sum() / ((t - t.mean()) ** 2).sum()
    a = np.hstack([np.ones((700, 1)), x])
    assert r2(p) > 0.75 > r2(a[500:] @ np.linalg.lstsq(a[:500], y[:500], rcond=None)[0]) + 0.2

    # The same loss over the exact kernel, as a combination of the training rows.
    z = (x - x[:500].mean(axis=0)) / x[:500].std(axis=0)
    kernel = np.exp(-((z[:, None, :] - z[None, :500, :]) ** 2).sum(axis=2) / 5)
    root = np.linalg.cholesky(kernel[:500] + 1e-6 * np.eye(500))

    def objective(theta):
        f = root @ theta[1:] + theta[0]
        loss, slope = K.insensitive(f - y[:500], 0.1)
        return loss.mean() + theta[1:] @ theta[1:] / (2 * 10 * 500), np.concatenate([[slope.mean()], root.T @ slope / 500 + theta[1:] / (10 * 500)])

    theta = K.minimised(objective, np.zeros(501), 3000, 1e-6)
    exact = kernel[500:] @ np.linalg.solve(root.T, theta[1:]) + theta[0]
    assert np.corrcoef(exact, p)[0, 1] > 0.97


def test_kernel_regression_of_odd_rows(spark):
    df = spark.createDataFrame([([1.0, 5.0], 2.0), (None, 1.0), ([2.0, 5.0], None), ([3.0, 5.0], 4.0)], "x array<double>, y double")
    model = K.KernelRegression.fit(df, "x", "y", features=16, passes=5)
    assert sum(r["predicted_activity"] is None for r in model.predict(df, "x").collect()) == 1
    with pytest.raises(ValueError):
        K.KernelRegression.fit(df.limit(0), "x", "y")


def test_p_values_of_correlations(spark):
    """Against the density of Student's t, integrated; and published ones (rounded coefficients, n = 30)."""
    from math import exp, lgamma, pi, sqrt

    from alembiq.operators import statistics as T

    def p(r, n):
        df, t = n - 2, abs(r) * sqrt((n - 2) / (1 - r * r))
        # The tail from t on, by the substitution x = t + s / (1 - s).
        m, total = 20000, 0.0
        for k in range(m):
            s = (k + 0.5) / m
            x = t + s / (1 - s)
            total += (1 + x * x / df) ** (-(df + 1) / 2) / (1 - s) ** 2 / m
        return 2 * total * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi * df)

    cases = [(r, n) for r in (0.0, 0.01, -0.048, 0.3, 0.6, 0.7, -0.75, 0.9, 0.97) for n in (4, 5, 12, 30, 400)] + [(0.01, 60000), (0.02, 60000), (0.03, 60000), (0.001, 10**7)]
    df = spark.createDataFrame(cases, "r double, n long")
    got = [x["p"] for x in df.select(T.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()]
    for (r, n), v in zip(cases, got):
        assert v == pytest.approx(p(r, n), rel=1e-6, abs=1e-12), (r, n)
    odd = spark.createDataFrame([(None, 9), (0.5, 2), (1.0, 9), (-1.0, 9)], "r double, n long")
    assert [x["p"] for x in odd.select(T.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()] == [None, None, 0.0, 0.0]
    assert T.spearman(spark.createDataFrame([(float(i), float(i * 7 % 11)) for i in range(11)], "x double, y double"), "x", "y").first()["p"] == pytest.approx(p(0.0 or 1 - 6 * sum((i - i * 7 % 11) ** 2 for i in range(11)) / (11 * 120), 11), rel=1e-6)


def test_density_is_one_and_close_to_the_sum_of_kernels(spark):
    from alembiq.operators import statistics as T

    r = np.random.default_rng(8)
    v = np.concatenate([r.normal(0, 1, 400), r.normal(6, 0.5, 200)])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    rows = T.density(df, "v", 400).orderBy("point").collect()
    x, got = np.array([m["x"] for m in rows]), np.array([m["density"] for m in rows])
    h = v.std(ddof=1) * len(v) ** -0.2
    want = np.exp(-(((x[:, None] - v[None]) / h) ** 2) / 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
    assert np.abs(got - want).max() < 1e-3 * want.max() and abs(np.trapezoid(got, x) - 1) < 5e-3
    assert T.density(df.limit(1), "v").collect() == [] and T.density(df.where("v IS NULL"), "v").collect() == []
    assert T.density(df.limit(1), "v", bandwidth=1.0).collect() == []
