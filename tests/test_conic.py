"""Conic programmes against their conditions, on every date; the threshold curve and boosted trees against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge import queries
from panelforge.operators import books, conic, learn

RNG = np.random.default_rng(4)


def problem(p, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, p)) * rng.uniform(0.01, 0.03, p)
    return rng.normal(size=p) * 0.01, np.cov(x.T) + np.eye(p) * 1e-6, rng.dirichlet(np.ones(p))


def gain(w, mu, cov, before, aversion, impact):
    return mu @ w - aversion * w @ cov @ w - impact * (np.abs(w - before) ** 1.5).sum()


@pytest.mark.parametrize("p,seed", [(6, 0), (25, 1), (40, 2)])
@pytest.mark.parametrize("aversion,impact,variance", [(2.0, 0.0, None), (1.0, 0.02, None), (0.0, 0.0, 1.5e-4), (1.0, 0.01, 1.2e-4)])
def test_no_feasible_step_gains(p, seed, aversion, impact, variance):
    mu, cov, before = problem(p, seed)
    w = conic.solve(mu, cov, before, aversion, impact, variance, cap=0.3)
    assert abs(w.sum() - 1) < 1e-6 and w.min() > -1e-8 and w.max() < 0.3 + 1e-8
    if variance is not None:
        least = conic.solve(np.zeros(p), cov, before, 1e3, cap=0.3)
        if least @ cov @ least > variance:
            return  # no weights are under the cap
        assert w @ cov @ w <= variance * (1 + 1e-3)
    own = gain(w, mu, cov, before, aversion, impact)
    for _ in range(400):
        other = books.project(RNG.dirichlet(np.ones(p) * RNG.choice([0.1, 1.0, 10.0])), 1.0, 0.0, 0.3)
        other = w + RNG.choice([1.0, 0.1, 0.01]) * (other - w)
        if variance is None or other @ cov @ other <= w @ cov @ w:
            assert gain(other, mu, cov, before, aversion, impact) <= own + 2e-6


def test_without_cones_it_is_the_plain_optimiser():
    mu, cov, before = problem(12, 3)
    np.testing.assert_allclose(conic.solve(mu, cov, before, 5.0, cap=0.2), books.markowitz(mu, cov, 5.0, 0.2, steps=3000), atol=2e-4)


def test_traded_least():
    for v in (-2.0, -1e-4, 0.0, 0.3, 5.0):
        x = np.linspace(-6, 6, 1_200_001)
        want = x[np.argmin(0.7 * np.abs(x) ** 1.5 + (x - v) ** 2 / 2)]
        assert conic.traded_least(np.array([v]), 0.7)[0] == pytest.approx(want, abs=2e-5)


def made(spark, dates=90, stocks=8):
    rng = np.random.default_rng(6)
    rows = [(t, n, float(rng.normal() * 0.01), float(rng.normal() * 0.02), True) for t in range(dates) for n in range(stocks)]
    return spark.createDataFrame(rows, "t int, n int, score double, ret double, valid boolean")


def test_every_date_is_solved_over_all_of_its_stocks(spark):
    rows = made(spark)
    found = conic.programmes(rows, (1.0, 4.0), impact=0.01, variance=1e-4, cap=0.4).toPandas()
    assert set(found["t"]) == {60, 80} and (found.groupby(["aversion", "t"])["n"].nunique() == 8).all()
    assert np.allclose(found.groupby(["aversion", "t"])["weight"].sum(), 1, atol=1e-6) and (found["variance"] <= 1e-4 * 1.001).all()
    assert sorted(r["aversion"] for r in conic.frontier(conic.programmes(rows, (1.0, 4.0))).collect()) == [1.0, 4.0]
    plain = books.optimised(rows, (1.0,), cap=0.4, step=15).toPandas()
    assert set(plain["t"]) == {60, 75} and (plain.groupby("t")["n"].nunique() == 8).all()
    history = rows.toPandas()
    for t, own in plain.groupby("t"):
        own = own.sort_values("n")
        past = history[(history.t < t) & (history.t >= t - 60)].pivot(index="t", columns="n", values="ret").to_numpy()
        mu = history[history.t == t].sort_values("n")["score"].to_numpy()
        cov = books.shrunk_covariance(past)
        grad, w = mu - 2 * cov @ own["weight"].to_numpy(), own["weight"].to_numpy()
        inside = (w > 1e-4) & (w < 0.4 - 1e-4)
        level = grad[inside].mean() if inside.any() else (grad[w <= 1e-4].max() + grad[w >= 0.4 - 1e-4].min()) / 2
        assert (grad[w <= 1e-4] <= level + 1e-4).all() and (grad[w >= 0.4 - 1e-4] >= level - 1e-4).all()
    assert books.optimised(rows, (1.0,), most=5).toPandas().groupby("t")["n"].nunique().max() == 5


def test_threshold_curve(spark):
    rows = [(0, "2024-12-30", 0.9, 0.05), (0, "2024-12-30", 0.8, -0.01), (0, "2024-12-30", 0.7, 0.5), (0, "2024-12-30", 0.2, -0.9), (1, "2024-12-31", 0.1, 0.1), (2, "2025-01-01", 0.6, -0.02), (3, "2025-01-02", 0.9, 0.3)]
    table = spark.createDataFrame(rows, "t int, date string, prediction double, ret double").withColumn("date", F.to_date("date"))
    got = books.threshold_curve(table).orderBy("t").collect()
    factors = [0.5 + 0.5 * 0.9989 * 1.02, 1.0, 0.5 + 0.5 * 0.9989 * 0.98, 1.0]
    np.testing.assert_allclose([r["equity"] for r in got], np.cumprod(factors))
    np.testing.assert_allclose([r["equity_of_year"] for r in got], [factors[0], factors[0], factors[2], factors[2]])
    assert [r["picked"] for r in got] == [3, 0, 1, 1]


def test_boosted_trees_tell_classes(spark):
    rng = np.random.default_rng(8)
    rows = [(t, n, float(x), 0.01 if x > 0 else -0.01, True) for t in range(20) for n in range(20) for x in [rng.normal()]]
    table = spark.createDataFrame(rows, "t int, n int, x double, target double, known boolean")
    got = learn.classified(table, ["x"], "target", "known", (0, 10, 10, 20)).join(table, ["t", "n"]).collect()
    assert len(got) == 200 and all(10 <= r["t"] < 20 for r in got)
    assert np.mean([(r["prediction"] > 0.5) == (r["x"] > 0) for r in got]) > 0.97


def test_registered_programmes(spark):
    for name in ("capped_variance", "impact_frontier"):
        assert name in queries.QUERIES and name not in queries.ORACLE
