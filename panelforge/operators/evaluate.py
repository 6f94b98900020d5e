"""Information coefficients and performance metrics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def guarded_corr(x: Column, y: Column, least: int = 2) -> Column:
    """Pearson correlation of an aggregation; 0 for fewer than least pairs or no spread."""
    n, spread = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)), F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.when((n >= least) & (spread > 1e-12), F.covar_pop(x, y) / F.greatest(spread, F.lit(1e-300))).otherwise(0.0)


def average_rank(x: Column, part: list[str]) -> Column:
    w = Window.partitionBy(*part).orderBy(x)
    return F.rank().over(w) + (F.count(F.lit(1)).over(w.rangeBetween(0, 0)) - 1) / 2.0


def daily_rank_ic(rows: DataFrame, factor: str, target: str, valid: str) -> DataFrame:
    """t, ic: Spearman's correlation of each date's valid rows; null for fewer than three."""
    fine = rows.where(F.col(valid)).select("t", factor, target)
    ranked = fine.select("t", average_rank(F.round(factor, 9), ["t"]).alias("a"), average_rank(F.round(target, 9), ["t"]).alias("b"))
    ic = ranked.groupBy("t").agg(F.count("*").alias("n"), guarded_corr(F.col("a"), F.col("b")).alias("ic"))
    return ic.select("t", F.when(F.col("n") >= 3, F.col("ic")).alias("ic"))


def ic_summary(daily: DataFrame) -> DataFrame:
    """Mean, median, deviation, share of positive dates (of all dates) and number of a daily series."""
    return daily.agg(F.avg("ic").alias("mean_ic"), F.median("ic").alias("median_ic"), F.stddev_samp("ic").alias("std_ic"), F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)).alias("positive_rate"), F.count("ic").alias("n_dates"))


def rolling_ic(daily: DataFrame, window: int = 60, least: int = 20) -> DataFrame:
    """The series with its mean over the last window dates, from least known ones on."""
    w = Window.orderBy("t").rowsBetween(1 - window, 0)  # a row per date: a calendar
    return daily.select("t", "ic", F.when(F.count("ic").over(w) >= least, F.avg("ic").over(w)).alias("rolling_ic"))


def pooled_ic(rows: DataFrame, factor: str, target: str, valid: str) -> DataFrame:
    """ic (Pearson's), rank_ic (Spearman's) and n_cells over all valid cells at once.

    Ranks of all cells need no window over all of them: cells are counted per distinct value, values fall into ranges by
    quantiles, and ranks are counted within a range and carried on by the ranges' totals.
    """
    fine = rows.where(F.col(valid)).select(F.round(factor, 9).alias("a"), F.round(target, 9).alias("b"), F.col(factor).alias("x"), F.col(target).alias("y"))
    ranked = pooled_rank(pooled_rank(fine, "a"), "b")
    return ranked.agg(guarded_corr(F.col("x"), F.col("y")).alias("ic"), guarded_corr(F.col("a"), F.col("b")).alias("rank_ic"), F.count("*").alias("n_cells"))


def pooled_rank(rows: DataFrame, column: str, ranges: int = 64) -> DataFrame:
    """rows with the column's average ranks among all of them in its place."""
    counted = rows.groupBy(column).agg(F.count("*").alias("__k"))
    bounds = counted.agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)], 1000).alias("__bounds"))
    placed = counted.join(F.broadcast(bounds)).withColumn("__range", F.size(F.filter(F.coalesce("__bounds", F.array().cast("array<double>")), lambda v: v < F.col(column)))).drop("__bounds")  # one row is broadcast
    totals = placed.groupBy("__range").agg(F.sum("__k").alias("__n"))  # at most as many rows as ranges
    before = totals.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.sum("__k").over(Window.partitionBy("__range").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    ranks = placed.join(F.broadcast(before), "__range").select(column, (F.col("__before") + within - (F.col("__k") - 1) / 2.0).alias("__rank"))
    return rows.join(ranks, column).drop(column).withColumnRenamed("__rank", column)


def rank_ic_loss(rows: DataFrame, prediction: str, target: str, temperature: float = 1.0) -> DataFrame:
    """t, rank_ic_loss: less the correlation of soft ranks, sums of sigmoids of differences, within each date. A date's rows are two arrays, see soft_ranks()."""
    p, y = F.col(prediction).cast("double"), F.col(target).cast("double")

    def of_date(table: pa.Table) -> pa.Table:
        a, b = (soft_ranks(table[c].to_numpy(), temperature) for c in ("p", "y"))
        spread = a.std() * b.std()
        loss = 0.0 if len(a) < 2 or spread <= 1e-12 else -float(((a - a.mean()) * (b - b.mean())).mean() / spread)
        return pa.table({"t": table["t"].slice(0, 1), "rank_ic_loss": pa.array([loss], pa.float64())})

    fine = rows.where(p.isNotNull() & y.isNotNull()).select("t", p.alias("p"), y.alias("y"))
    return fine.groupBy("t").applyInArrow(of_date, f"t {rows.schema['t'].dataType.simpleString()}, rank_ic_loss double")


#: Polynomials of a cell, and how many cells off sigmoids are one or nothing: both leave errors below those of sums of doubles.
DEGREES, REACH = 14, 40


def cell_kernel(off: int) -> np.ndarray:
    """Coefficients k, l of the sigmoid of the difference, in Chebyshev polynomials of the places in a cell and in one so many cells before."""
    angles = (np.arange(DEGREES) + 0.5) * math.pi / DEGREES
    x = np.cos(angles)
    with np.errstate(over="ignore"):
        values = 1 / (1 + np.exp(-(off + (x[:, None] - x[None, :]) / 2)))
    turn = np.cos(np.outer(np.arange(DEGREES), angles)) * 2 / DEGREES
    turn[0] /= 2
    return turn @ values @ turn.T


def polynomials(u: np.ndarray) -> Iterator[np.ndarray]:
    """Chebyshev polynomials of u by degree."""
    before, now = u, np.ones(len(u))
    for _ in range(DEGREES):
        yield now
        before, now = now, 2 * u * now - before


def soft_ranks(x: np.ndarray, temperature: float) -> np.ndarray:
    """The sum over all y of sigmoid((x - y) / temperature), for each x, without a pass over all pairs.

    Values fall into cells as wide as the temperature. Across a cell a sigmoid is a polynomial, as its nearest pole is pi cells away, to
    1e-15; so a cell's values act by their sums of polynomials, cell on cell, and those over REACH cells off by their number.
    """
    if not np.isfinite(x).all():
        return np.full(len(x), np.nan)  # as each sum has the value's own difference
    cell = np.floor(x / temperature)
    u = 2 * (x / temperature - cell) - 1
    cells, own = np.unique(cell, return_inverse=True)
    sums = np.stack([np.bincount(own, weights=p, minlength=len(cells)) for p in polynomials(u)], axis=1)
    acted = np.zeros_like(sums)
    for off in range(-REACH, REACH + 1):
        source = np.searchsorted(cells, cells - off)
        found = source < len(cells)
        found[found] = cells[found] - cells[source[found]] == off  # so far from nothing that cells are further apart than one, none is found
        if found.any():
            acted[found] += sums[source[found]] @ cell_kernel(off).T
    acted[:, 0] += np.concatenate([[0.0], np.cumsum(sums[:, 0])])[np.searchsorted(cells, cells - REACH)]
    out = np.zeros(len(x))
    for k, p in enumerate(polynomials(u)):
        out += acted[own, k] * p
    return out


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def gelu(x: Column) -> Column:
    """x times the normal distribution at x, by the usual approximation with tanh."""
    return x / 2 * (1 + F.tanh((x + 0.044715 * x * x * x) * 0.7978845608028654))


def metrics(curve: DataFrame, periods: int = 252, by: str = "strategy") -> DataFrame:
    """Per strategy, of curve (strategy, t, net): the usual figures of a return series."""
    w = Window.partitionBy(by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    equity = curve.withColumn("equity", F.exp(F.sum(F.log1p(F.greatest("net", F.lit(-0.999999999)))).over(w)))
    peaked = equity.withColumn("fall", 1 - F.col("equity") / F.max("equity").over(w))
    loss, year = F.when(F.col("net") < 0, F.col("net")), F.sqrt(F.lit(float(periods)))
    out = peaked.groupBy(by).agg(
        F.count("*").alias("n_periods"), F.avg("net").alias("mean"), F.stddev_samp("net").alias("std"), F.count(loss).alias("losses"), F.stddev_samp(loss).alias("loss_std"),
        F.max("fall").alias("max_drawdown"), F.max_by("equity", "t").alias("final_equity"),
    )
    std, loss_std = F.coalesce("std", F.lit(0.0)), F.coalesce("loss_std", F.lit(0.0))
    ann = F.pow("final_equity", periods / F.col("n_periods")) - 1
    return out.select(
        by, "n_periods", "final_equity", ann.alias("ann_return"), (std * year).alias("ann_vol"), F.when(std < 1e-12, 0.0).otherwise(F.col("mean") / F.greatest(std, F.lit(1e-300)) * year).alias("sharpe"),
        F.when(F.col("losses") == 0, float("inf")).when(loss_std < 1e-12, 0.0).otherwise(F.col("mean") / F.greatest(loss_std, F.lit(1e-300)) * year).alias("sortino"),
        "max_drawdown", F.when(F.col("max_drawdown") < 1e-12, float("inf")).otherwise(ann / F.greatest("max_drawdown", F.lit(1e-300))).alias("calmar"),
    )


def backtest_summary(curve: DataFrame, benchmark: str | None = None, periods: int = 252) -> DataFrame:
    """metrics() of curve (strategy, t, gross, cost, turnover, net) with turnover (the mean after the first date), cost_drag_cumulative, gross figures and, with a strategy as benchmark, info_ratio and alpha_ann of what is earned over it."""
    year = F.sqrt(F.lit(float(periods)))
    annual = lambda r: F.exp(F.sum(F.log1p(F.greatest(r, F.lit(-0.999999999)))) * periods / F.count(r)) - 1
    ratio = lambda r: F.when(F.coalesce(F.stddev_samp(r), F.lit(0.0)) < 1e-12, 0.0).otherwise(F.avg(r) / F.greatest(F.stddev_samp(r), F.lit(1e-300)) * year)
    more = [F.coalesce(F.avg(F.when(F.col("t") > 0, F.col("turnover"))), F.lit(0.0)).alias("turnover"), F.sum("cost").alias("cost_drag_cumulative"), annual(F.col("gross")).alias("gross_ann_return"), ratio(F.col("gross")).alias("gross_sharpe")]
    rows = curve
    if benchmark is not None:
        rows = curve.join(curve.where(F.col("strategy") == benchmark).select("t", F.col("net").alias("__base")), "t")
        active = F.col("net") - F.col("__base")
        more += [ratio(active).alias("info_ratio"), annual(active).alias("alpha_ann")]
    return metrics(curve, periods).join(rows.groupBy("strategy").agg(*more), "strategy")


def adjusted_mse(rows: DataFrame, prediction: str, target: str, gamma: float = 0.1) -> DataFrame:
    """Mean squared error, weighted by gamma where the signs agree and by 1 + gamma where they don't."""
    if gamma <= 0:
        raise ValueError("gamma is over 0")
    p, y = F.col(prediction), F.col(target)
    return rows.agg(F.avg((p - y) * (p - y) * F.when(p * y > 0, gamma).otherwise(1 + gamma)).alias("adjusted_mse"), (-guarded_corr(p, y)).alias("ic_loss"))
