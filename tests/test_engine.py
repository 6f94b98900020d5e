"""Primitives against pandas, masks against poison, operators against hand-made cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions.factors import FAMILIES, REGISTRY
from panelforge.operators import books, evaluate, relate, section
from panelforge.plans import compiler, expr
from panelforge.sources import panel as panels
from panelforge.sources import universes
from panelforge.streaming import bars as stream

T, N = 40, 6


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(0)
    x, y, mask = rng.normal(10, 2, (T, N)).round(2), rng.normal(5, 1, (T, N)).round(2), rng.random((T, N)) < 0.9
    mask[:, 5] = False
    return x, y, mask


@pytest.fixture(scope="module")
def panel(spark, cells):
    x, y, mask = cells
    t, n = np.meshgrid(np.arange(T), np.arange(N), indexing="ij")
    pdf = pd.DataFrame({"t": t.ravel(), "n": n.ravel(), "close": x.ravel(), "volume": y.ravel() * 100, "mask": mask.ravel()})
    for name, shift in (("open", 0.1), ("high", 1.0), ("low", -1.0), ("vwap", 0.05)):
        pdf[name] = pdf["close"] + shift
    pdf["amount"] = pdf["vwap"] * pdf["volume"]
    return spark.createDataFrame(pdf).withColumns({c: F.col(c).cast("int") for c in ("t", "n")}).cache()


def grid(df, column="value"):
    out = np.full((T, N), np.nan)
    for r in df.collect():
        if r[column] is not None:
            out[r["t"], r["n"]] = r[column]
    return out


c, v = expr.field("close"), expr.field("volume")


def rolling(x, mask, k, how, least):
    frame = pd.DataFrame(np.where(mask, x, np.nan)).rolling(k, min_periods=least)
    out = getattr(frame, how)().to_numpy()
    out[: k - 1] = np.nan
    return out


@pytest.mark.parametrize(
    ("value", "how", "least"),
    [(expr.ts_mean(c, 5), "mean", 1), (expr.ts_std(c, 5), "std", 2), (expr.ts_min(c, 5), "min", 1), (expr.ts_max(c, 5), "max", 1), (expr.ts_sum(c, 5), "sum", 5)],
)
def test_rolling(panel, cells, value, how, least):
    x, _, mask = cells
    got = grid(compiler.evaluate(panel, {"value": value}, T))
    np.testing.assert_allclose(got, rolling(x, mask, 5, how, least), rtol=1e-9)


def test_corr_and_rank(panel, cells):
    x, y, mask = cells
    got = compiler.evaluate(panel, {"corr": expr.ts_corr(c, v, 6), "rank": expr.cs_rank(c), "tsrank": expr.ts_rank(c, 4)}, T).toPandas()
    for r in got.itertuples():
        seen = mask[: r.t + 1, r.n][-6:]
        if r.t >= 5 and seen.sum() >= 3:
            a, b = x[r.t - 5 : r.t + 1, r.n][seen], y[r.t - 5 : r.t + 1, r.n][seen]
            assert r.corr == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9)
        if mask[r.t, r.n]:
            assert r.rank == pytest.approx(pd.Series(x[r.t][mask[r.t]]).rank(pct=True)[np.flatnonzero(np.flatnonzero(mask[r.t]) == r.n)[0]])
        if r.t >= 3 and mask[r.t - 3 : r.t + 1, r.n].all():
            assert r.tsrank == pytest.approx((x[r.t - 3 : r.t + 1, r.n] <= x[r.t, r.n]).mean())
        else:
            assert np.isnan(r.tsrank)


@pytest.mark.parametrize("alpha", [0.05, 0.5, 0.97, 1.0])
def test_ewma_recurrence(panel, cells, alpha):
    x, _, mask = cells
    want, level = np.full((T, N), np.nan), np.zeros(N)
    for t in range(T):
        level = alpha * np.where(mask[t], x[t], 0) + (1 - alpha) * level
        want[t] = np.where(mask[t], level, np.nan)
    for n_dates in (T, 10**6):  # the second takes the form for long panels
        got = grid(compiler.evaluate(panel, {"value": expr.ewma(c, alpha)}, n_dates))
        np.testing.assert_allclose(got, want, rtol=1e-9)


def test_delay_keeps_the_mask_of_the_past(panel, cells):
    x, _, mask = cells
    got = grid(compiler.evaluate(panel, {"value": expr.delay(c, 2)}, T))
    want = np.full((T, N), np.nan)
    want[2:] = np.where(mask[:-2], x[:-2], np.nan)
    np.testing.assert_allclose(got, want)


def test_errors():
    for bad in (lambda: expr.delay(c, -1), lambda: expr.ewma(c, 0), lambda: expr.ewma(c, 1.5), lambda: expr.ts_mean(c, 0), lambda: section.forward_return(None, 0)):
        with pytest.raises(ValueError):
            bad()


def test_registry():
    assert len(REGISTRY) == 213 and sum(map(len, FAMILIES.values())) == 213


def test_poison_does_not_reach_valid_cells(panel):
    """What untradable cells hold changes no factor that is valid only on tradable ones."""
    names = ["best_001", "best_004", "best_007", "add_001", "change_005", "old_027", "original_007", "alpha_101", "alpha_012"]
    poisoned = panel.withColumns({x: F.when(F.col("mask"), F.col(x)).otherwise(1e9) for x in ("open", "high", "low", "close", "volume", "vwap", "amount")})
    values = {name: REGISTRY[name] for name in names}
    one, other = (compiler.evaluate(p, values, T).orderBy("t", "n").toPandas() for p in (panel, poisoned))
    mask = panel.orderBy("t", "n").toPandas()["mask"].to_numpy()
    np.testing.assert_allclose(one[names].to_numpy()[mask], other[names].to_numpy()[mask], rtol=1e-9)


def test_passes_alternate_and_are_few():
    roots = [r for name in FAMILIES["old"] for r in (REGISTRY[name].value, REGISTRY[name].under())]
    axes = [axis for axis, _ in expr.stages(roots)]
    assert 1 + sum(a != b for a, b in zip(axes, axes[1:], strict=False)) <= 6


def test_neutral_is_orthogonal(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"t": np.repeat([0, 1], 30), "n": list(range(30)) * 2, "x": rng.normal(size=60), "s": rng.normal(size=60), "g": [i % 4 for i in range(30)] * 2, "mask": True})
    pdf.loc[5, "mask"] = False
    got = section.neutralise_industry(spark.createDataFrame(pdf), "x", "g", size="s").toPandas()
    for _, day in got.groupby("t"):
        fine = day[day["mask"]]
        assert abs(fine.groupby("g")["neutral"].sum()).max() < 1e-9 and abs((fine["neutral"] * fine["s"]).sum()) < 1e-9
        assert fine["neutral"].std(ddof=0) == pytest.approx(1)
    assert got.loc[~got["mask"], "neutral"].eq(0).all()


def test_backtest_lags_weights_and_costs_are_linear(spark):
    w = np.array([[1, 0], [0, 1], [1, 0], [0, 1]], float)
    r = np.array([[0.5, 0.5], [0, 0.3], [0.2, 0.1], [-0.2, 0.3]])
    rows = [("a", t, n, float(w[t, n])) for t in range(4) for n in range(2)]
    weights = spark.createDataFrame(rows, "strategy string, t int, n int, weight double")
    returns = spark.createDataFrame([(t, n, float(r[t, n])) for t in range(4) for n in range(2)], "t int, n int, ret double")
    got = books.backtest(weights, returns, 10).orderBy("t").toPandas()
    np.testing.assert_allclose(got["gross"], [0, 0, 0.1, -0.2])
    np.testing.assert_allclose(got["cost"], [0, 0.002, 0.002, 0.002])
    np.testing.assert_allclose(books.backtest(weights, returns, 1).orderBy("t").toPandas()["cost"] * 10, got["cost"])


def test_metrics(spark):
    rows = [("flat", t, 0.0) for t in range(4)] + [("one", 0, 0.1), ("one", 1, -0.5), ("one", 2, 0.2)]
    got = {r["strategy"]: r for r in evaluate.metrics(spark.createDataFrame(rows, "strategy string, t int, net double")).collect()}
    assert got["flat"]["sharpe"] == 0 and got["flat"]["ann_return"] == 0 and got["flat"]["sortino"] == float("inf")
    assert got["one"]["max_drawdown"] == pytest.approx(0.5) and got["one"]["final_equity"] == pytest.approx(1.1 * 0.5 * 1.2)
    assert got["one"]["sortino"] == 0


def test_books(spark):
    rows = spark.createDataFrame([(t, n, float((n * 7 + t * 3) % 10), n != 9) for t in range(12) for n in range(10)], "t int, n int, score double, valid boolean")
    top = books.top_quantile(rows, "score").toPandas()
    assert np.allclose(top.groupby("t")["weight"].sum(), 1) and top[top["n"] == 9]["weight"].eq(0).all()
    held = books.rebalanced(books.top_quantile(rows, "score"), 4).toPandas().pivot(index="t", columns="n", values="weight")
    assert (held.loc[0] == held.loc[3]).all() and (held.loc[4] == held.loc[7]).all()
    calm = books.buffered(rows.withColumn("strategy", F.lit("b")), 0.2, 0.6).where("weight > 0").toPandas()
    assert np.allclose(calm.groupby("t")["weight"].sum(), 1)



def test_scores_never_see_their_own_date(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"t": np.repeat(range(30), 20), "n": list(range(20)) * 30, "f": rng.normal(size=600), "g": rng.normal(size=600), "valid": True})
    pdf["y"] = pdf["f"] * 0.5 + rng.normal(size=600)
    run = lambda p: books.ic_weighted_score(spark.createDataFrame(p), ["f", "g"], "y", "valid", 20).orderBy("t", "n").toPandas()
    later = pdf.copy()
    later.loc[later["t"] >= 25, "y"] = 99.0 * later["g"]
    one, other = run(pdf), run(later)
    np.testing.assert_allclose(one[one["t"] <= 25]["score"], other[other["t"] <= 25]["score"])
    assert np.corrcoef(one[one["t"] == 25]["score"], pdf[pdf["t"] == 25]["f"])[0, 1] > 0.8


def test_optimiser():
    rng = np.random.default_rng(0)
    mu, x = rng.normal(0.001, 0.0005, 20), rng.normal(0, 0.02, (250, 20))
    cov = books.shrunk_covariance(x)
    assert np.linalg.eigvalsh(cov).min() > 0
    low, high = (books.markowitz(mu, cov, a, 0.1) for a in (1.0, 100.0))
    for w in (low, high):
        assert w.sum() == pytest.approx(1) and w.max() <= 0.1 + 1e-9 and w.min() >= -1e-12
        gradient = mu - 2 * (1.0 if w is low else 100.0) * cov @ w
        free = (w > 1e-6) & (w < 0.1 - 1e-6)
        assert np.ptp(gradient[free]) < 1e-4 if free.sum() > 1 else True
    assert high @ cov @ high <= low @ cov @ low + 1e-12
    assert books.capped(np.array([5.0, 1, 1, 1]), 0.4).tolist() == pytest.approx([0.4, 0.2, 0.2, 0.2])
    assert books.walk_forward(10, 4, 3, 3) == [(0, 4, 4, 7), (3, 7, 7, 9)]


def test_csv_panel(spark, tmp_path):
    rows = ["TRADE_DT\tS_INFO_WINDCODE\topen\thigh\tlow\tclose\tvolume\tvwap", "20240102\t600519.SH\t1\t2\t0.5\t1.5\t10\t1.2", "20240102\t600519.SH\t9\t9\t9\t9\t9\t9", "20240103\t000001.SZ\t3\t4\t2\t\t5\t3"]
    path = tmp_path / "bars.tsv"
    path.write_text("\n".join(rows))
    panel, n_dates = panels.load_csv(spark, str(path))
    got = {(r["t"], r["stock"]): r for r in panel.collect()}
    assert n_dates == 2 and len(got) == 4
    assert got[0, "600519"]["close"] == 1.5 and got[0, "600519"]["mask"] and not got[1, "000001"]["mask"] and not got[0, "000001"]["mask"]
    with pytest.raises(KeyError):
        panels.resolve(["date"], "open")


def test_tickers(spark):
    codes = spark.createDataFrame([("600519",), ("SH600519",), ("sh.600519",), ("000001.SZ",), ("abc",)], "code string")
    got = {r["code"]: (r["ticker"], r["market"]) for r in universes.normalised_tickers(codes).collect()}
    assert got["SH600519"] == got["600519"] == got["sh.600519"] == ("600519", "sh") and got["000001.SZ"] == ("000001", "sz") and got["abc"] == (None, None)


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "events"))
    query = stream.event_bars(source).writeStream.format("memory").queryName("bars").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    bars = lambda df: {tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()}
    got = bars(spark.table("bars"))
    assert got and got == bars(stream.event_bars(events))
    query = stream.smoothed(source, 0.5).writeStream.format("memory").queryName("levels").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("levels").count() == events.count()


def test_streams_go_on_after_a_restart_and_drop_late_rows(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, value double"

    def arrive(name, rows):
        frame = pd.DataFrame([(i, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h), u, float(v)) for i, h, u, v in rows], columns=["event_id", "ts", "user_id", "value"])
        frame.to_parquet(tmp_path / "in" / f"{name}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)

    (tmp_path / "in").mkdir()
    first = [(1, 1, 7, 1), (2, 2, 7, 3), (3, 2, 8, 5), (4, 60, 7, 2)]
    second = [(5, 3, 7, 100), (6, 61, 7, 4), (2, 62, 7, 9), (4, 60, 7, 2), (7, 120, 8, 1)]  # 5 comes after its window, 4 again
    third = [(8, 200, 7, 1)]
    streams = {
        "bars": lambda e: stream.event_bars(e),
        "sliding": lambda e: stream.event_bars(e, "2 days", "1 day"),
        "sessions": lambda e: stream.sessions(e),
        "deduplicated": lambda e: stream.deduplicated(e),
        "levels": lambda e: stream.smoothed(e, 0.5, "1 day", idle_ms=24 * 3_600_000),
    }
    arrive("a", first)
    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for part in (None, second, third):
        if part:
            arrive({id(second): "b", id(third): "c"}[id(part)], part)
        got = {name: stream.drained(build(source()), str(tmp_path / name)).toPandas() for name, build in streams.items()}
    table = lambda rows: spark.createDataFrame([(i, (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)).to_pydatetime(), u, float(v)) for i, h, u, v in rows], schema)
    on_time = table([*first, *second[1:], *third])
    passed = pd.Timestamp("2024-01-01") + pd.Timedelta(hours=200 - 24)
    for name, width in (("bars", 24), ("sliding", 48)):
        # the window of two days from the first was open still when 5 came, a day's weren't
        want = streams[name](on_time if name == "bars" else table([*first, *second, *third])).toPandas()
        if name == "sliding":
            closed = want["start"] == pd.Timestamp("2023-12-31")
            want = pd.concat([want[~closed], streams[name](on_time).toPandas().query("start == '2023-12-31'")])
        want = want[want["start"] + pd.Timedelta(hours=width) <= passed]
        key = ["user_id", "start"]
        pd.testing.assert_frame_equal(got[name].sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True))
    want = streams["sessions"](on_time).toPandas()
    want = want[want["end"] <= passed]
    pd.testing.assert_frame_equal(got["sessions"].sort_values(["user_id", "start"]).reset_index(drop=True), want.sort_values(["user_id", "start"]).reset_index(drop=True))
    # 4 is known still, 2 was forgotten when the watermark passed it, 5 was late
    assert sorted(got["deduplicated"]["event_id"]) == [1, 2, 2, 3, 4, 6, 7, 8]
    levels = {(r.event_id, r.ts.hour + 24 * (r.ts.day - 1)): r.level for r in got["levels"].itertuples()}
    assert levels[1, 1] == 0.5 and levels[2, 2] == 1.75 and levels[4, 60] == 1.875 and (5, 3) not in levels
    assert levels[6, 61] == 0.5 * 4 + 0.5 * (0.5 * 2 + 0.5 * 1.875) and levels[8, 200] == 0.5  # user 7 was idle for longer than a day


def test_segments_and_as_of(spark):
    bars = spark.createDataFrame([("a", "2024-01-01", 1.0), ("a", "2024-01-05", 2.0), ("a", "2024-02-01", 3.0), ("b", "2024-01-01", 4.0)], "stock string, date string, close double").withColumn("date", F.to_date("date"))
    assert [r["seg"] for r in relate.segments(bars).orderBy("stock", "date").collect()] == [0, 0, 1, 0]
    snaps = spark.createDataFrame([("a", "2024-01-02", 7.0)], "stock string, date string, w double").withColumn("date", F.to_date("date"))
    assert [r["w"] for r in relate.as_of(bars, snaps, "w").orderBy("stock", "date").collect()] == [None, 7.0, 7.0, None]
