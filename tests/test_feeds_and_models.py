"""Sources, books and models against brute force and hand-made cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge import queries
from panelforge.functions.factors import FAMILIES, REGISTRY
from panelforge.operators import books, evaluate, learn, relate, section
from panelforge.plans import compiler
from panelforge.sources import feeds, universes
from panelforge.sources import panel as panels
from panelforge.sources.synthetic import Market


def cells(df):
    return {(r["t"], r["stock"]): r for r in df.collect()}


def test_aliases_prefer_plain_names(spark, tmp_path):
    names = ["TRADE_DT", "S_INFO_WINDCODE", "S_FWDS_ADJOPEN", "open", "high", "low", "CLOSE", "S_FWDS_ADJCLOSE", "volume", "vwap", "S_DQ_LIMIT", "S_DQ_STOPPING", "S_DQ_PRECLOSE"]
    (tmp_path / "x.tsv").write_text("\t".join(names) + "\n" + "\t".join(["20240102", "600519.SH", "9", "1", "2", "0.5", "8", "1.5", "10", "1.2", "3", "0.1", "1.4"]))
    r = panels.load_csv(spark, str(tmp_path / "x.tsv"))[0].first()
    assert (r["open"], r["close"], r["limit_up"], r["limit_down"], r["last_close"]) == (1, 1.5, 3, 0.1, 1.4)


def test_delimited_loaders_keep_the_first_row(spark, tmp_path):
    (tmp_path / "p.csv").write_text("date,open,high,low,close,volume\n2024-01-02,1,3,1,2,10\n2024-01-02,9,9,9,9,9\n")
    r = panels.load_plain_csv(spark, str(tmp_path / "p.csv"))[0].first()
    assert (r["close"], r["vwap"], r["stock"]) == (2, 2, "asset")
    line = lambda x: f"20240102\tA\t{x}\t{x}\t{x}\t{x}\t{x}\t10\t0\t2\t1\t1\n"
    (tmp_path / "h.tsv").write_text(line(1.5) + line(7))
    r = panels.load_headerless(spark, str(tmp_path / "h.tsv"))[0].first()
    assert (r["close"], r["amount"], r["last_close"]) == (1.5, 15, 1)


def test_service_panels(spark):
    rows = spark.createDataFrame([("2024-01-02", "B", 1.0, 4.0, 1.0, 2.0, 10), ("2024-01-03", "B", 1.0, 2.0, None, 2.0, 10)], "Date string, Ticker string, Open double, High double, Low double, Close double, Volume int")
    panel, n_dates = feeds.make_panel(spark, "titled", rows=rows, tickers=["B", "A"])
    got = cells(panel)
    assert n_dates == 2 and got[0, "B"]["n"] == 0 and got[0, "B"]["vwap"] == 2 and got[0, "B"]["mask"] and not got[1, "B"]["mask"] and not got[0, "A"]["mask"]
    rows = spark.createDataFrame([("2024-01-02", "sh.600000", "1", "2", "1", "1.5", "5", "7", "1.2", "1"), ("2024-01-03", "sh.600000", "1", "2", "1", "1.5", "5", "7", "1.5", "0"), ("2024-01-04", "sh.600000", "", "2", "1", "1.5", "5", "7", "1.5", "1")], "date string, code string, open string, high string, low string, close string, volume string, amount string, preclose string, tradestatus string")
    got = cells(feeds.make_panel(spark, "status", rows=rows, tickers=["SH.600000"])[0])
    assert [got[t, "sh.600000"]["mask"] for t in range(3)] == [True, False, False] and got[0, "sh.600000"]["last_close"] == 1.2
    rows = spark.createDataFrame([("2024-01-02", "600519", 1.0, 2.0, 3.0, 0.5, 10.0, 20.0)], "`日期` string, code string, `开盘` double, `收盘` double, `最高` double, `最低` double, `成交量` double, `成交额` double")
    got = cells(feeds.make_panel(spark, "chinese", rows=rows, tickers=["SH600519", "000001.SZ"])[0])
    assert got[0, "600519"]["amount"] == 20 and not got[0, "000001"]["mask"]
    with pytest.raises(ValueError):
        feeds.make_panel(spark, "chinese", rows=rows, tickers=["000001"])
    with pytest.raises(ValueError):
        feeds.make_panel(spark, "status", rows=rows, tickers=["sh.600000"], proxy_vwap=False)
    with pytest.raises(ValueError):
        feeds.make_panel(spark, "nowhere")
    with pytest.raises(TypeError):
        feeds.make_panel(spark, "csv")
    assert feeds.make_panel(spark, "synthetic", stocks=3, dates=5)[1] == 5 and Market.stocks > 3


def test_tickers_and_universes(spark):
    codes = ["sh.600519", "000001.SZ", "600519", "SZ000002", "bj:430047", "AAPL", "sh.bad", "6005190", None]
    got = {r["code"]: (r["ticker"], r["market"]) for r in universes.normalised_tickers(spark.createDataFrame([(c,) for c in codes], "code string")).collect()}
    assert got == {"sh.600519": ("600519", "sh"), "000001.SZ": ("000001", "sz"), "600519": ("600519", "sh"), "SZ000002": ("000002", "sz"), "bj:430047": ("430047", "bj"), **dict.fromkeys(["AAPL", "sh.bad", "6005190", None], (None, None))}
    assert feeds.listed(spark, ["SH.600000", " ", "sz.000001", "sh.600000"], universes.dotted) == ["sh.600000", "sz.000001"]
    for wrong, form in (("AAPL", universes.six_digits), ("600000.SS", universes.dotted), ("sh.bad", universes.dotted)):
        with pytest.raises(ValueError):
            feeds.listed(spark, ["sh.600000", wrong], form)
    table = spark.createDataFrame([("x", "600519", "1"), ("600000", "000001", "2"), (None, "000001", "3")], "a string, b string, c string")
    assert sorted(r["stock"] for r in universes.members(table).collect()) == ["000001", "600519"]
    assert universes.members(table.select("c")).count() == 0 and universes.members(table.limit(0)).count() == 0
    found = universes.first_with_members({"one": table.select("c"), "two": table, "three": table.select("a")}).collect()
    assert sorted(map(tuple, found)) == [("two", "000001"), ("two", "600519")]
    stocks = lambda *args, **more: [r["stock"] for r in universes.universe(spark, *args, **more).orderBy("turn").collect()]
    assert stocks("etf-50", most=2) == ["SPY", "QQQ"] and len(stocks("mixed-150")) == 150 and len(stocks("cn-large-25", form=universes.dotted)) == 25
    assert stocks("", "600519.sh", form=universes.six_digits) == ["600519"] and stocks("csi-300", most=1, index=table) == ["000001"]
    with pytest.raises(ValueError):
        stocks("hs300")


def test_downloads_are_repeated_and_merged(spark, tmp_path):
    def fetch(code):
        tried = tmp_path / code
        before = tried.exists()
        tried.touch()
        if code == "bad" or (code == "b" and not before):
            raise OSError("busy")
        return [{"date": "2024-01-02", "close": 1.0}] if code != "none" else []

    codes = spark.createDataFrame([(c,) for c in ("a", "b", "bad", "none")], "code string")
    rows = [r.asDict() for r in feeds.downloaded(codes, fetch, "date string, close double", waits=(0.0,)).collect()]
    assert {(r["code"], r["close"], r["error"]) for r in rows} == {("a", 1.0, None), ("b", 1.0, None), ("bad", None, "OSError: busy")}
    got = feeds.downloaded(codes, lambda c: [{"date": "2024-01-02", "close": 1.0}], "date string, close double").where("code in ('a', 'b')")
    bulk = got.withColumn("close", F.when(F.col("code") == "a", F.col("close")))
    again = spark.createDataFrame([("2024-01-02", 5.0, "a"), ("2024-01-02", 6.0, "b")], "date string, close double, code string")
    assert {(r["code"], r["close"]) for r in feeds.merged_downloads(bulk, again).collect()} == {("a", 1.0), ("b", 6.0)}


def grid(spark, rng, dates=70, stocks=12):
    score, ret, valid = rng.normal(size=(dates, stocks)).round(3), rng.normal(0, 0.02, (dates, stocks)), rng.random((dates, stocks)) < 0.85
    score[rng.random(score.shape) < 0.05] = np.nan
    rows = [("s", t, n, float(score[t, n]), float(ret[t, n]), bool(valid[t, n])) for t in range(dates) for n in range(stocks)]
    return score, ret, valid, spark.createDataFrame(rows, "strategy string, t int, n int, score double, ret double, valid boolean").cache()


def dense(df, shape, column="weight"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["t"], r["n"]] = np.nan if r[column] is None else r[column]
    return out


def test_buffered_holds_all_in_the_zone(spark):
    score, _, valid, rows = grid(spark, np.random.default_rng(0))
    want, held = np.zeros(score.shape), set()
    for t in range(len(score)):
        fine = [n for n in range(score.shape[1]) if valid[t, n] and np.isfinite(score[t, n])]
        fine.sort(key=lambda n: (-round(score[t, n], 9), -n))
        wanted = max(1, math.ceil(len(fine) * 0.2 - 1e-9))
        held &= set(fine[: max(wanted, math.ceil(len(fine) * 0.5 - 1e-9))])
        for n in fine:
            if len(held) >= wanted:
                break
            held.add(n)
        for n in held:
            want[t, n] = 1 / len(held)
    np.testing.assert_allclose(dense(books.buffered(rows, 0.2, 0.5), score.shape), want)
    with pytest.raises(ValueError):
        books.buffered(rows, 0.3, 0.2)


def test_candidate_weights(spark):
    score, ret, valid, rows = grid(spark, np.random.default_rng(1))
    want, previous = np.zeros(score.shape), np.zeros(score.shape[1])
    for t in range(len(score)):
        if t < len(score) - 1 and t >= 20 and t % 10 == 0:
            fine = [n for n in range(score.shape[1]) if valid[t, n] and np.isfinite(score[t, n])]
            best = sorted(sorted(fine, key=lambda n: (-score[t, n], -n))[:5])
            x = ret[t - 20 : t, best] - ret[t - 20 : t, best].mean(0)
            s = x.T @ x / len(x)
            mu = np.trace(s) / len(best)
            delta = ((s - mu * np.eye(len(best))) ** 2).sum() / len(best)
            beta = min((((x**2).T @ x**2 / len(x) - s**2).sum() / len(x)) / len(best), delta)
            variance = np.diag(beta / delta * mu * np.eye(len(best)) + (1 - beta / delta) * s)
            z = (score[t, best] - score[t, best].mean()) / score[t, best].std()
            raw = z / np.sqrt(np.maximum(variance, 1e-8) * 2.0)
            previous = np.zeros(score.shape[1])
            previous[best] = books.capped(raw - raw.min(), 0.3)
        want[t] = previous
    np.testing.assert_allclose(dense(books.candidate_weights(rows, 5, 20, 10, 0.3, 2.0), score.shape), want, atol=1e-9)
    assert (want.sum(1)[20:] > 0.999).all() and want.max() <= 0.3 + 1e-9


def test_ic_weights_need_history_and_valid_cells(spark):
    rng = np.random.default_rng(2)
    f, g, valid = rng.normal(size=(40, 10)), rng.normal(size=(40, 10)), rng.random((40, 10)) < 0.9
    y = 0.5 * f + rng.normal(size=f.shape)
    rows = spark.createDataFrame([(t, n, float(f[t, n]), float(g[t, n]), float(y[t, n]), bool(valid[t, n])) for t in range(40) for n in range(10)], "t int, n int, f double, g double, y double, valid boolean")
    got = dense(books.ic_weighted_score(rows, ["f", "g"], "y", "valid", 25, 4), f.shape, "score")
    for t in range(40):
        past = valid[max(0, t - 25) : t]
        if t < 20 or t % 4 or past.sum() < 100:
            assert np.isnan(got[t]).all()
            continue
        w = np.array([np.corrcoef(x[max(0, t - 25) : t][past], y[max(0, t - 25) : t][past])[0, 1] for x in (f, g)])
        want = np.where(valid[t], (f[t] * w[0] + g[t] * w[1]) / np.abs(w).sum(), np.nan)
        np.testing.assert_allclose(got[t], want)


def test_limits_and_breadth_use_last_close(spark):
    rows = [(0, 0, 10.0, 10.0, 0.0, True), (1, 0, 11.0, 12.0, 8.0, True), (2, 0, 11.0, 11.5, 11.0, False), (3, 0, 11.0, 11.0, 0.0, True)]
    panel = spark.createDataFrame(rows, "t int, n int, open double, close double, last_close double, mask boolean")
    assert [r["free"] for r in section.limit_move_mask(panel, 0.6).orderBy("t").collect()] == [False, True, False, False]
    assert [r["free"] for r in section.limit_move_mask(panel.drop("last_close"), 0.1).orderBy("t").collect()] == [False, False, False, True]
    got = {(r["t"], r["family"]): r["bucket"] for r in section.breadth(panel).collect()}
    assert got == {(0, "CR"): 0, (1, "CR"): 10, (1, "OR"): 10, (3, "CR"): 0}
    got = {(r["t"], r["family"]): r["bucket"] for r in section.breadth(panel.drop("last_close")).collect()}
    assert got == {(0, "CR"): 0, (1, "CR"): 10, (1, "OR"): 10, (3, "CR"): 0, (3, "OR"): -4}
    banded = panel.withColumns({"limit_up": F.lit(12.0), "limit_down": F.when(F.col("t") == 3, 0.0).otherwise(1.0)})
    assert [r["free"] for r in section.limit_move_mask(banded, 0.6).orderBy("t").collect()] == [False, False, False, False]


def test_block_bootstrap_bounds(spark):
    curve = spark.createDataFrame([("flat", t, 0.01) for t in range(30)] + [("up", t, 0.01 * (t % 3)) for t in range(30)], "strategy string, t int, net double")
    got = {r["strategy"]: r for r in books.block_bootstrap(curve, 50, 7, periods=30).collect()}
    assert got["flat"]["ann_return_low"] == pytest.approx(1.01**30 - 1) == got["flat"]["ann_return_high"] and got["flat"]["sharpe_high"] == 0
    assert got["up"]["ann_return_low"] <= 1.01**10 * 1.02**10 - 1 <= got["up"]["ann_return_high"] + 0.02


def test_summary_against_a_benchmark(spark):
    rng = np.random.default_rng(3)
    net = rng.normal(0, 0.01, (2, 40))
    rows = [(s, t, float(net[i, t] + 0.001), 0.001, 0.1 + i, float(net[i, t])) for i, s in enumerate("ab") for t in range(40)]
    got = {r["strategy"]: r for r in evaluate.backtest_summary(spark.createDataFrame(rows, "strategy string, t int, gross double, cost double, turnover double, net double"), "a").collect()}
    active = net[1] - net[0]
    assert got["b"]["info_ratio"] == pytest.approx(active.mean() / active.std(ddof=1) * math.sqrt(252)) and got["a"]["info_ratio"] == 0
    assert got["b"]["alpha_ann"] == pytest.approx(np.prod(1 + active) ** (252 / 40) - 1) and got["b"]["turnover"] == pytest.approx(1.1) and got["b"]["cost_drag_cumulative"] == pytest.approx(0.04)


def test_walk_forward_scales_by_training_rows_only(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(3, 2, (60, 10))
    rows = spark.createDataFrame([(t, n, float(x[t, n]), float(2 * x[t, n] + 1), t != 41) for t in range(60) for n in range(10)], "t int, n int, x double, y double, valid boolean")
    splits = books.walk_forward(60, 30, 10, 8)
    got = {(r["t"], r["n"]): r["prediction"] for r in learn.walk_forward_predictions(rows, ["x"], "y", "valid", splits).collect()}
    assert {t for t, _ in got} == set(range(30, 59)) - {41}
    assert all(got[t, n] == pytest.approx(2 * x[t, n] + 1, abs=0.05) for t, n in got)
    assert learn.walk_forward_predictions(rows, ["x"], "y", "valid", [(0, 2, 2, 5)]).count() == 0
    with pytest.raises(ValueError):
        learn.walk_forward_predictions(rows, ["x"], "y", "valid", splits, "net")


def test_synthetic_returns_have_each_stocks_moments(spark):
    rng = np.random.default_rng(5)
    ret, mask = rng.normal([0.0, 0.01], [0.02, 0.1], (400, 2)), rng.random((400, 2)) < 0.8
    rows = spark.createDataFrame([(t, n, float(ret[t, n]), bool(mask[t, n])) for t in range(400) for n in range(2)], "t int, n int, ret double, mask boolean")
    one, other = (learn.gbm_augment(df, 5, 20, 1).orderBy("n", "t").toPandas() for df in (rows, rows.repartition(7)))
    np.testing.assert_allclose(one["ret"], other["ret"], rtol=1e-9)
    assert len(one) == 4000
    for n in range(2):
        seen, made = ret[mask[:, n], n], one[one["n"] == n]["ret"]
        assert made.std() == pytest.approx(seen.std(ddof=1), rel=0.1) and made.mean() == pytest.approx(seen.mean(), abs=3 * seen.std() / 40)
    with pytest.raises(ValueError):
        learn.gbm_augment(rows, 1, 401)


def test_losses_and_activations(spark):
    rng = np.random.default_rng(6)
    p, y = rng.normal(size=(2, 8))
    rows = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(p, y, strict=True)], "t int, p double, y double")
    soft = lambda x: (1 / (1 + np.exp(-(x[:, None] - x[None, :])))).sum(1)
    assert evaluate.rank_ic_loss(rows, "p", "y").first()["rank_ic_loss"] == pytest.approx(-np.corrcoef(soft(p), soft(y))[0, 1])
    got = rows.select(evaluate.sigmoid(F.col("p")).alias("s"), evaluate.gelu(F.col("p")).alias("g")).toPandas()
    np.testing.assert_allclose(got["s"], 1 / (1 + np.exp(-p)))
    np.testing.assert_allclose(got["g"], p * np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in p]), atol=1e-3)
    many = rows.withColumn("ok", F.lit(True)).union(spark.createDataFrame([(0, 9.0, 9.0, False)], "t int, p double, y double, ok boolean"))
    r = evaluate.pooled_ic(many, "p", "y", "ok").first()
    assert r["n_cells"] == 8 and r["rank_ic"] == pytest.approx(np.corrcoef(pd.Series(p).rank(), pd.Series(y).rank())[0, 1]) and r["ic"] == pytest.approx(np.corrcoef(p, y)[0, 1])


def test_relations(spark):
    rows = spark.createDataFrame([(t, 0, float(t)) for t in range(6)], "t int, n int, x double")
    got = relate.before_row(rows, "x", 3).orderBy("t").collect()
    assert [r["x_mean"] for r in got] == [None, 0, 0.5, 1, 2, 3] and got[5]["x_min"] == 2
    applied = relate.rolling_apply(rows, "x", 3, lambda seen: F.array_max(seen) - F.array_min(seen), 2).orderBy("t").collect()
    assert [r["applied"] for r in applied] == [None, 1, 2, 2, 2, 2]
    assert relate.rolling_apply(rows, "x", None, F.size).orderBy("t").collect()[5]["applied"] == 6
    assert relate.with_dimension(rows, spark.createDataFrame([(0, "a"), (9, "b")], "n int, name string"), ["n"]).count() == 7
    days = spark.createDataFrame([(0, 0.1, 1.0), (1, 0.1, 2.0), (2, 0.2, 0.5), (3, 0.3, 3.0)], "t int, ret double, level double")
    got = books.gated_equity(days).orderBy("t").collect()
    assert [r["ret"] for r in got] == [0.1, 0.1, 0.0, 0.3] and got[3]["equity"] == pytest.approx(1.1 * 1.1 * 1.3)
    panel = spark.createDataFrame([(t, 0, "a") for t in range(4)], "t int, n int, stock string")
    assert panels.between(panel, 1, 3).count() == 2 and panels.universe(panel, spark.createDataFrame([("b",)], "stock string")).count() == 0
    reports = spark.createDataFrame([(("x", "p"), [("s", 0.5), ("u", None)]), (("y", "p"), [("r", 2.0)])], "metadata struct<source:string,preset:string>, results array<struct<strategy:string,sharpe:double>>")
    assert [r["strategy"] for r in relate.leaderboard(reports).collect()] == ["r", "s", "u"]
