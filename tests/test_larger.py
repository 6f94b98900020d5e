"""What larger tables need: the same results by ways that don't grow with the square of a date's stocks, or by plans that send less."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import books, conic, evaluate, hashes, learn, relate
from panelforge.plans.store import stored
from panelforge.sources import panel as panels

RNG = np.random.default_rng(12)


def returns(p, dates=60):
    return np.clip(RNG.normal(size=(dates, p)) * RNG.uniform(0.01, 0.08, p) + RNG.normal(size=(dates, 1)) * 0.01, -0.1, 0.1)


@pytest.mark.parametrize("p", [1, 7, 60, 61, 200])
def test_the_spectrum_is_the_shrunk_covariance(p):
    x, w = returns(p), RNG.normal(size=p)
    cov, spectrum = books.shrunk_covariance(x), books.shrunk_spectrum(x)
    np.testing.assert_allclose(spectrum.times(w), cov @ w, rtol=1e-9, atol=1e-14)
    assert spectrum.variance(w) == pytest.approx(w @ cov @ w) and spectrum.largest() == pytest.approx(np.linalg.eigvalsh(cov)[-1])
    assert spectrum.vectors.shape == (p, min(p, 60))


@pytest.mark.parametrize("aversion,impact,variance", [(0.0, 0.0, 4e-4), (1.0, 0.01, 4e-4), (2.0, 0.01, None)])
def test_programmes_by_the_spectrum_are_those_of_the_matrix(aversion, impact, variance):
    x, mu, before = returns(150), RNG.normal(size=150) * 0.1, np.full(150, 1 / 150)
    whole = conic.solve(mu, books.shrunk_covariance(x), before, aversion, impact, variance)
    np.testing.assert_allclose(conic.solve(mu, books.shrunk_spectrum(x), before, aversion, impact, variance), whole, atol=1e-9)
    np.testing.assert_allclose(books.markowitz(mu, books.shrunk_spectrum(x), aversion), books.markowitz(mu, books.shrunk_covariance(x), aversion), atol=1e-9)


def test_a_date_of_many_stocks_makes_no_matrix_of_them():
    p = 40_000  # their matrix has 12.8 GB
    spectrum, mu = books.shrunk_spectrum(returns(p)), RNG.normal(size=p) * 0.1
    for w in (conic.solve(mu, spectrum, np.full(p, 1 / p), 1.0, 0.01, 4e-4, steps=20), books.markowitz(mu, spectrum, steps=20)):
        assert w.sum() == pytest.approx(1) and w.min() >= 0 and w.max() <= 0.05 + 1e-12


@pytest.mark.parametrize("low,high,total", [(0.0, 0.05, 1.0), (-0.05, 0.05, 1.0), (0.0, 1 / 50, 1.0), (0.0, 1.0, 0.3)])
def test_projections_meet_their_conditions(low, high, total):
    for scale in (1e-6, 1.0, 1e3):
        v = RNG.normal(size=50) * scale
        w = books.project(v, total, low, high)
        assert w.sum() == pytest.approx(total, abs=1e-9) and w.min() >= low and w.max() <= high
        inside = (w > low) & (w < high)
        if inside.any():
            m = (v - w)[inside].mean()
            np.testing.assert_allclose(np.clip(v - m, low, high), w, atol=1e-9 * max(1, scale))


@pytest.mark.parametrize("temperature", [0.05, 1.0])
@pytest.mark.parametrize("values", [RNG.normal(size=400) * 0.2, RNG.normal(size=300) * 40, np.repeat([0.1, -0.1, 0.0, 3.7], 50), np.array([0.25]), np.r_[RNG.normal(size=50), 1e6, 1e6 + 0.01, -1e300, 1e300]])
def test_soft_ranks_are_sums_over_all_pairs(values, temperature):
    with np.errstate(over="ignore"):
        want = (1 / (1 + np.exp(-(values[:, None] - values[None, :]) / temperature))).sum(1)
    np.testing.assert_allclose(evaluate.soft_ranks(values, temperature), want, rtol=1e-9)


def test_a_date_of_many_rows_has_soft_ranks(spark):
    rows = spark.range(60_000).selectExpr("cast(id % 2 as int) as t", "sin(id) as p", "cos(id * 0.3) / 10 as y")  # 1.8 thousand million pairs
    got = {r["t"]: r["rank_ic_loss"] for r in evaluate.rank_ic_loss(rows, "p", "y", 0.05).collect()}
    assert set(got) == {0, 1} and all(abs(v) < 0.05 for v in got.values())
    odd = spark.createDataFrame([(0, 1.0, 2.0), (1, 1.0, None), (2, float("nan"), 1.0), (2, 1.0, 2.0), (3, 1.0, 5.0), (3, 2.0, 5.0)], "t int, p double, y double")
    got = {r["t"]: r["rank_ic_loss"] for r in evaluate.rank_ic_loss(odd, "p", "y").collect()}
    assert got[0] == 0 and got[3] == 0 and np.isnan(got[2]) and 1 not in got


def test_digests_of_arrays_are_those_of_the_library():
    for size, ending in ((1, b""), (7, b"60|0"), (40, b"1|-12345"), (50, b"12345"), (51, b"12345"), (80, b"x")):
        texts = RNG.integers(33, 126, (30, size)).astype(np.uint8)
        one, two = hashes.uniform_pairs(texts, ending)
        want = [hashlib.md5(bytes(x) + ending).hexdigest() for x in texts]
        assert one.tolist() == [int(h[:13], 16) / 2**52 for h in want] and two.tolist() == [int(h[13:26], 16) / 2**52 for h in want]


def test_paths_are_those_of_their_keys(spark):
    rows = [(t, n, 0.01 * n, 0.001 * t, 0.02) for t in (3, 20, 356) for n in (0, 9, 10, 123456)]
    got = learn.simulated_targets(spark.createDataFrame(rows, "t int, n int, gap double, mu double, sigma double"), steps=12, seed=7).collect()
    assert len(got) == 2 * len(rows)
    for t, n, gap, mu, sigma in rows:
        for r in [r for r in got if (r["t"], r["n"]) == (t, n)]:
            at, seen = gap, []
            for j in range(1, 13):
                h = hashlib.md5(f"{n}|{t}|{r['path']}|{j}|7".encode()).hexdigest()
                one, two = int(h[:13], 16) / 2**52, int(h[13:26], 16) / 2**52
                at += (mu - sigma**2 / 2) / 12 + sigma * np.sqrt(-2 * np.log(1 - one)) * np.cos(2 * np.pi * two) / np.sqrt(12)
                seen.append(at)
            np.testing.assert_allclose([r["target"], r["top"], r["bottom"]], [np.clip(at, -0.2, 0.2), max(seen), min(seen)], rtol=1e-9)


def test_nearest_is_the_first_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 4)), float(rng.choice([rng.integers(-9, 9) / 4, np.nan, np.inf, -np.inf], p=[0.9, 0.04, 0.03, 0.03]))) for i in range(120)]
    rows = [(i, g, None if i % 17 == 0 else v) for i, g, v in rows] + [(200, 7, 1.0), (201, 8, None), (202, 8, 3.0), (203, 9, float("nan")), (204, 9, None), (300, None, 1.0), (301, None, 1.0)]
    stocks = spark.createDataFrame(rows, "stock int, grp int, value double")
    got = {r["stock"]: r["near"] for r in relate.nearest(stocks, "grp", "value").collect()}
    a, b = stocks.alias("a"), stocks.alias("b")
    pairs = a.join(b, F.col("a.grp") == F.col("b.grp")).where("a.stock <> b.stock").select(F.col("a.stock").alias("stock1"), F.col("b.stock").alias("stock2"), F.expr("-abs(a.value - b.value)").alias("rel"))
    want = {r["stock1"]: r["stock2"] for r in relate.keep_first(pairs, ["stock1"], [F.desc("rel"), F.asc("stock2")]).collect()}
    assert got == want and 200 not in got


def test_neighbours_make_no_pairs(spark):
    found = relate.nearest(spark.range(100_000).selectExpr("id as stock", "1 as grp", "cast(id * 37 % 100000 as double) as value"), "grp", "value")  # ten thousand million pairs
    assert found.where("abs(near * 37 % 100000 - stock * 37 % 100000) <> 1").count() == 0 and found.count() == 100_000


def test_splits_read_what_is_stored_once(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(t, n, float(rng.normal()), float(rng.normal()), True) for t in range(40) for n in range(10)], "t int, n int, x double, y double, known boolean")
    kept = []

    def store(df):
        kept.append(stored(df))
        return kept[-1]

    splits = books.walk_forward(40, 20, 10, 10)
    plain = learn.walk_forward_predictions(rows, ["x"], "y", "known", splits).orderBy("t", "n").collect()
    found = learn.walk_forward_predictions(rows, ["x"], "y", "known", splits, store=store)
    assert len(kept) == 1 and len(plain) > 100 and set(found.inputFiles()) <= set(kept[0].inputFiles())
    assert np.allclose([r["prediction"] for r in found.orderBy("t", "n").collect()], [r["prediction"] for r in plain])


def test_a_held_zone_is_walked_date_by_date(spark):
    rng = np.random.default_rng(9)
    rows = [(s, t, n, float(rng.normal()), bool(rng.random() < 0.8 and (t, s) != (7, "b"))) for s in ("a", "b") for t in range(30) for n in range(700)]
    table = spark.createDataFrame(rows, "strategy string, t int, n int, score double, valid boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")  # a date's zone comes in several batches
    try:
        got = {(r["strategy"], r["t"], r["n"]): r["weight"] for r in books.buffered(table).where("weight > 0").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, held, last = {}, [], None
    for s in ("a", "b"):
        for t in range(30):
            zone = [n for _, n in sorted(((-round(score, 9), -n), n) for a, b, n, score, valid in rows if (a, b) == (s, t) and valid)]
            wanted, leave = (max(1, int(np.ceil(len(zone) * share - 1e-9))) for share in (0.2, 0.3))
            before, zone = held if last == s else [], zone[:leave]
            stays = [n for n in zone if n in set(before)]
            held, last = stays + [n for n in zone if n not in set(before)][: max(0, wanted - len(stays))], s
            want |= {(s, t, n): 1 / len(held) for n in held}
    assert got == pytest.approx(want) and not any(key[:2] == ("b", 7) for key in got)


def test_no_group_has_all_zones(spark):
    table = spark.createDataFrame([("a", 0, 0, 1.0, True)], "strategy string, t int, n int, score double, valid boolean")
    assert "FlatMapGroups" not in books.buffered(table)._jdf.queryExecution().toString()


def test_the_panel_of_line_items_is_the_dense_grid_of_their_bars(spark):
    lineitem = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    got, dates = panels.trade_panel(lineitem)
    want, same = panels.densify(panels.trade_bars(lineitem), keys=panels.trade_keys(lineitem))
    assert dates == same and got.columns == want.columns
    key = lambda df: df.toPandas().sort_values(["n", "t"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(key(got), key(want))
    for panel in (got, want):  # bars may be broadcast where they are few, the grid never
        assert "BuildLeft" not in panels.violations(panel)._jdf.queryExecution().executedPlan().toString()
    assert got._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
