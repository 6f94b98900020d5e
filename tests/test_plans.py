"""Plans of several passes, and sections over more tasks than dates, against plain plans."""

import numpy as np
import pandas as pd
import pytest

from panelforge import queries
from panelforge.functions.factors import FAMILIES, REGISTRY
from panelforge.plans import compiler, expr, sections
from panelforge.plans.store import stored
from panelforge.sources import feeds

X, Y = expr.field("x"), expr.field("y")
SECTIONS = {
    "rank": expr.cs_rank(X), "down": expr.cs_rank(X, descending=True), "z": expr.cs_zscore(Y), "scale": expr.cs_scale(Y, 3.0),
    "nested": expr.cs_zscore(expr.cs_rank(X) + expr.cs_rank(Y)), "over_time": expr.cs_rank(expr.ts_mean(expr.cs_rank(Y), 2)), "joined": expr.ts_sum(expr.cs_scale(X), 2),
}


def panel_of(spark, dates, stocks, seed=0):
    rng = np.random.default_rng(seed)
    t, n = np.divmod(np.arange(dates * stocks), stocks)
    x = np.where(rng.random(len(t)) < 0.4, 0.0, rng.normal(size=len(t)).round(2))  # a third and more are one value
    frame = pd.DataFrame({"t": t.astype("int32"), "n": n.astype("int32"), "x": x, "y": rng.normal(size=len(t)), "mask": rng.random(len(t)) < 0.9})
    return spark.createDataFrame(frame).repartition(4)


def same(a, b, names, rtol=1e-9):
    both = a.toPandas().merge(b.toPandas(), on=["t", "n"])
    assert len(both) == a.count()
    for name in names:
        np.testing.assert_allclose(both[f"{name}_x"].astype(float), both[f"{name}_y"].astype(float), rtol=rtol, atol=1e-12)
    return both


@pytest.mark.parametrize("dates,stocks", [(1, 3000), (4, 300), (3, 1)])
def test_sections_split_over_tasks(spark, dates, stocks):
    panel = panel_of(spark, dates, stocks)
    plain = compiler.evaluate(panel, SECTIONS, dates)
    split = compiler.evaluate(panel, SECTIONS, dates, store=stored, split=True)
    both = same(plain, split, SECTIONS)
    assert both["rank_x"].notna().any()


def test_a_date_of_many_stocks_is_in_many_ranges(spark):
    kept = []

    def store(df):
        kept.append(stored(df))
        return kept[-1]

    compiler.evaluate(panel_of(spark, 1, 20_000), {"rank": expr.cs_rank(Y)}, 1, store=store, split=True).collect()
    placed = next(df for df in kept if "__range" in df.columns)
    sizes = [r["count"] for r in placed.groupBy("__range").count().collect()]
    assert len(sizes) == sections.RANGES and max(sizes) < 3 * sum(sizes) / len(sizes)


def test_no_window_collects_lists(spark):
    panel = panel_of(spark, 30, 3)
    values = {"top": expr.ts_argmax(X, 7), "low": expr.ts_argmin(X, 13), "product": expr.ts_product(Y, 11), "one": expr.ts_argmax(X, 1), "nested": expr.ts_argmax(expr.ts_product(Y, 2), 20)}
    found = compiler.evaluate(panel, values, 30)
    assert "collect_list" not in found._jdf.queryExecution().toString()
    got = found.toPandas().sort_values(["n", "t"])
    frame = panel.toPandas().sort_values(["n", "t"])
    for n, rows in frame.groupby("n"):
        own = got[got.n == n]
        for k, name, pick, fill in ((7, "top", np.argmax, -1.7e308), (13, "low", np.argmin, 1.7e308)):
            x = np.where(rows["mask"], rows["x"], fill)
            want = [pick(x[i - k + 1 : i + 1]) + 1 if i >= k - 1 and rows["mask"].iloc[i - k + 1 : i + 1].any() else np.nan for i in range(30)]
            np.testing.assert_array_equal(own[name].astype(float), want)
        y = np.where(rows["mask"], rows["y"], np.nan)
        want = [np.prod(y[i - 10 : i + 1]) if i >= 10 else np.nan for i in range(30)]
        np.testing.assert_allclose(own["product"].astype(float), want, rtol=1e-9)
        assert set(own["one"].dropna()) <= {1.0}


def test_passes_that_are_stored_give_the_same(spark):
    panel, n_dates = feeds.make_panel(spark, "synthetic", stocks=4, dates=130)
    panel = panel.cache()
    names = [*FAMILIES["alpha"], *FAMILIES["best"][:3]]
    got = queries.whole_set(panel, n_dates, names)
    single = compiler.evaluate(panel, queries.joint_set(queries.factor_set(names)), n_dates)
    both = same(got, single, names)
    assert both[[f"{name}_x" for name in names]].notna().all(axis=1).sum() == both[f"{names[0]}_x"].notna().sum() > 0 and len(REGISTRY) == 213
