"""Portfolio weights and the backtest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def over_time() -> WindowSpec:
    return Window.partitionBy("n").orderBy("t")


def equal_weight(rows: DataFrame, valid: str = "valid") -> DataFrame:
    """t, n, weight: 1 / valid stocks of the date."""
    count = F.sum(F.col(valid).cast("int")).over(Window.partitionBy("t"))
    return rows.select("t", "n", F.when(F.col(valid), 1.0 / F.greatest(count, F.lit(1))).otherwise(0.0).alias("weight"))


def top_quantile(rows: DataFrame, score: str, valid: str = "valid", quantile: float = 0.2) -> DataFrame:
    """t, n, weight: the best max(1, ceil(valid * quantile)) stocks, equally; ties go to the larger n."""
    part = Window.partitionBy("t", valid)
    place = F.row_number().over(part.orderBy(F.round(score, 9).desc(), F.col("n").desc()))
    number = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(part) * quantile - 1e-9))
    return rows.withColumns({"__place": place, "__number": number}).select("t", "n", F.when(F.col(valid) & (F.col("__place") <= F.col("__number")), 1.0 / F.col("__number")).otherwise(0.0).alias("weight"))


def momentum_score(panel: DataFrame, window: int = 20) -> DataFrame:
    """panel with score: close over close window rows before, less one; 0 in the first rows."""
    past = F.lag("close", window).over(over_time())
    return panel.withColumn("score", F.when(F.col("t") >= window, F.col("close") / F.greatest(past, F.lit(1e-12)) - 1).otherwise(0.0))


def rebalanced(weights: DataFrame, step: int) -> DataFrame:
    """Weights of every step-th date, held in between."""
    held = F.last(F.when(F.col("t") % step == 0, F.col("weight")), ignorenulls=True).over(over_time())
    return weights.select("t", "n", F.coalesce(held, F.lit(0.0)).alias("weight"))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], np.ndarray, np.ndarray]]:
    """(strategy, t), stocks (-1: none) and numbers wanted of each stretch of a date in ordered batches."""
    for batch in batches:
        strategies, t = batch["strategy"].to_pylist(), batch["t"].to_numpy()
        n, wanted = (pc.fill_null(batch[c], -1).to_numpy().astype(np.int64) for c in ("n", "wanted"))
        starts = [0, *[i for i in range(1, len(t)) if t[i] != t[i - 1] or strategies[i] != strategies[i - 1]], len(t)]
        for start, end in zip(starts, starts[1:]):
            if end > start:
                yield (strategies[start], int(t[start])), n[start:end], wanted[start:end]


def buffered(rows: DataFrame, target: float = 0.2, leave: float = 0.3) -> DataFrame:
    """strategy, t, n, weight with hysteresis: every stock held stays while it is among the best leave, and the best others come while fewer than target are held.

    rows: strategy, t, n, score, valid; a score that isn't finite doesn't take part, ties go to the larger n. The ranked stocks of the
    zone, of each date, are found first; what is held depends on the date before: one ordered pass over them per strategy, which has a date's zone at a time.
    """
    if leave < target:
        raise ValueError(f"the zone that stocks leave, {leave}, is at least the target, {target}")
    fine = F.col("valid") & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    part = Window.partitionBy("strategy", "t", "__fine")
    ranked = rows.withColumn("__fine", F.coalesce(fine, F.lit(False))).withColumns({"__place": F.row_number().over(part.orderBy(F.round("score", 9).desc(), F.col("n").desc())), "__count": F.count("*").over(part)})
    number = lambda share: F.greatest(F.lit(1), F.ceil(F.col("__count") * share - 1e-9))
    sized = ranked.withColumn("__wanted", number(target)).withColumn("__zone", F.greatest("__wanted", number(leave)))
    # a date without a zone is one row without a stock: nothing is held through it
    zones = sized.where(F.when(F.col("__fine"), F.col("__place") <= F.col("__zone")).otherwise(F.col("__place") == 1))
    ordered = zones.select("strategy", "t", F.when(F.col("__fine"), F.col("n")).alias("n"), F.col("__wanted").cast("int").alias("wanted"), F.col("__place").alias("place")).repartition("strategy").sortWithinPartitions("strategy", "t", "place")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, strategy = np.empty(0, np.int64), None
        for (own, t), days in groupby(runs(batches), key=lambda run: run[0]):
            zone, wanted = (np.concatenate(parts) for parts in zip(*[run[1:] for run in days], strict=True))
            fine = zone >= 0
            zone, wanted = zone[fine], wanted[fine].max(initial=0)
            stays = np.isin(zone, held) if own == strategy else np.zeros(len(zone), bool)
            held, strategy = np.concatenate([zone[stays], zone[~stays][: max(0, wanted - stays.sum())]]), own
            if len(held):
                p = len(held)
                yield pa.RecordBatch.from_arrays([pa.array([own] * p, pa.string()), pa.array(np.full(p, t), pa.int32()), pa.array(np.sort(held), pa.int32()), pa.array(np.full(p, 1.0 / p))], ["strategy", "t", "n", "weight"])

    kept = ordered.mapInArrow(walk, "strategy string, t int, n int, weight double")
    return rows.select("strategy", "t", "n").join(kept, ["strategy", "t", "n"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def backtest(weights: DataFrame, returns: DataFrame, costs_bps: float = 5.0) -> DataFrame:
    """strategy, t, gross, cost, net. weights: strategy, t, n, weight; returns: t, n, ret, both dense.

    A date earns the weights of the date before; changing weights costs costs_bps of what is traded, but for the first date.
    """
    own = Window.partitionBy("strategy", "n").orderBy("t")
    moved = weights.join(returns.select("t", "n", "ret"), ["t", "n"]).withColumn("__before", F.lag("weight", 1, 0.0).over(own))
    traded = F.when(F.col("t") > 0, F.abs(F.col("weight") - F.col("__before"))).otherwise(0.0)
    daily = moved.groupBy("strategy", "t").agg(F.sum(F.col("__before") * F.col("ret")).alias("gross"), (F.sum(traded) * costs_bps * 1e-4).alias("cost"), (F.sum(traded) * 0.5).alias("turnover"))
    return daily.withColumn("net", F.col("gross") - F.col("cost"))


def cost_grid(weights: DataFrame, returns: DataFrame, levels=(0.0, 7.0, 15.0, 30.0)) -> DataFrame:
    """The backtest at several cost levels: strategy is suffixed by the level. Gross returns are computed once."""
    base = backtest(weights, returns, 1.0)
    grid = F.explode(F.array(*[F.lit(float(x)) for x in levels]))
    return base.select("*", grid.alias("bps")).select(F.concat_ws(" @ ", "strategy", F.format_string("%.2f_bps", "bps")).alias("strategy"), "t", "gross", (F.col("cost") * F.col("bps")).alias("cost"), "turnover", (F.col("gross") - F.col("cost") * F.col("bps")).alias("net"))


def ic_weighted_score(rows: DataFrame, factors: list[str], target: str, valid: str, lookback: int = 60, step: int = 1) -> DataFrame:
    """t, n, score: factors weighted by their pooled correlation with the target over the lookback dates before (20 at least).

    There is a score on every step-th date from the 20th on whose history has max(100, 30 * factors) valid cells, for valid cells with
    all factors; elsewhere it is null. A factor with fewer than 30 pairs, or no spread, has weight 0. Sums of products per
    date are the sufficient statistics; a window over dates adds them up, and never sees its own date.
    """
    lookback = max(20, lookback)
    usable = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    fine = rows.where(F.col(valid)).select("t", usable(target).alias("y"), *[usable(f).alias(f) for f in factors])
    pair = lambda f, e: F.when(F.col(f).isNotNull() & F.col("y").isNotNull(), e)
    sums = [F.sum(pair(f, e)).alias(f"{k}_{f}") for f in factors for k, e in (("k", F.lit(1.0)), ("x", F.col(f)), ("y", F.col("y")), ("xx", F.col(f) * F.col(f)), ("yy", F.col("y") * F.col("y")), ("xy", F.col(f) * F.col("y")))]
    daily = rows.select("t").distinct().join(fine.groupBy("t").agg(F.count("*").alias("cells"), *sums), "t", "left")
    past = Window.orderBy("t").rangeBetween(-lookback, -1)  # a row per date: a calendar
    s = lambda c: F.coalesce(F.sum(c).over(past), F.lit(0.0))
    weights = {"__cells": s("cells")}
    for f in factors:
        n = F.greatest(s(f"k_{f}"), F.lit(1.0))
        cov = s(f"xy_{f}") / n - s(f"x_{f}") / n * s(f"y_{f}") / n
        spread = F.sqrt(F.greatest(s(f"xx_{f}") / n - F.pow(s(f"x_{f}") / n, 2), F.lit(0.0)) * F.greatest(s(f"yy_{f}") / n - F.pow(s(f"y_{f}") / n, 2), F.lit(0.0)))
        weights[f"w_{f}"] = F.when((s(f"k_{f}") >= 30) & (spread * n > 1e-12), cov / F.greatest(spread, F.lit(1e-300))).otherwise(0.0)
    table = daily.select("t", *[w.alias(name) for name, w in weights.items()])
    size = sum((F.abs(f"w_{f}") for f in factors), F.lit(0.0))
    mixed = sum((F.col(f"w_{f}") * usable(f) for f in factors), F.lit(0.0))
    scored = (F.col("t") >= 20) & (F.col("t") % step == 0) & (F.col("__cells") >= max(100, 30 * len(factors))) & (size > 1e-12) & F.col(valid)
    return rows.join(table, "t").select("t", "n", F.when(scored, mixed / F.greatest(size, F.lit(1e-12))).alias("score"))


def capped(raw: np.ndarray, cap: float) -> np.ndarray:
    """Non-negative weights that add up to one, none above cap where that is possible: the excess goes to the others in proportion."""
    raw = np.maximum(np.asarray(raw, float), 0)
    if not len(raw):
        return raw
    raw = raw if raw.sum() > 0 else np.ones(len(raw))
    cap, w = max(cap, 1 / len(raw)), raw / raw.sum()
    full = np.zeros(len(w), bool)
    while (w > cap + 1e-12).any():
        full |= w > cap + 1e-12
        rest = raw[~full].sum()
        w = np.where(full, cap, raw / rest * (1 - cap * full.sum()) if rest > 0 else 0)
    return w


def shrunk_covariance(x: np.ndarray) -> np.ndarray:
    """Ledoit and Wolf's (2004) shrinkage of the sample covariance toward a multiple of the identity."""
    n, p = x.shape
    x = x - x.mean(0)
    s = x.T @ x / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min((((x**2).T @ (x**2) / n - s**2).sum() / n) / p, d2)
    shrink = b2 / d2 if d2 > 0 else 0.0
    return shrink * mu * np.eye(p) + (1 - shrink) * s


def project(v: np.ndarray, total: float, low: float, high: float) -> np.ndarray:
    """The nearest point to v with low <= w <= high that adds up to total, by Newton's steps for the multiplier, and by bisection where they leave its bounds."""
    a, b = (v - high).min(), (v - low).max()
    m = min(max((v.sum() - total) / len(v), a), b)
    for _ in range(100):
        w = np.clip(v - m, low, high)
        over = w.sum() - total
        if over > 0:
            a = m
        else:
            b = m
        inside = np.count_nonzero((w > low) & (w < high))
        following = m + over / inside if inside else (a + b) / 2
        following = following if a <= following <= b else (a + b) / 2
        if following == m or b - a <= 1e-16 * abs(m):
            break
        m = following
    return np.clip(v - m, low, high)


class Spectrum:
    """A covariance as some eigenvectors, their values, and one value for all directions beside them: as many rows as stocks, as many columns as dates at most."""

    def __init__(self, vectors: np.ndarray, values: np.ndarray, rest: float):
        self.vectors, self.values, self.rest = vectors, values, rest

    @classmethod
    def of(cls, cov: np.ndarray | Spectrum) -> Spectrum:
        if isinstance(cov, Spectrum):
            return cov
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)
        return cls(vectors, values, 0.0)

    @property
    def size(self) -> int:
        return len(self.vectors)

    def at_least(self, floor: float) -> Spectrum:
        return Spectrum(self.vectors, np.maximum(self.values, floor), max(self.rest, floor))

    def largest(self) -> float:
        """The largest eigenvalue."""
        beside = [self.rest] if self.size > len(self.values) else []
        return max([*beside, *self.values])

    def mean(self) -> float:
        """The mean eigenvalue."""
        return (self.values.sum() + (self.size - len(self.values)) * self.rest) / self.size

    def times(self, w: np.ndarray) -> np.ndarray:
        return self.rest * w + self.vectors @ ((self.values - self.rest) * (w @ self.vectors))

    def variance(self, w: np.ndarray) -> float:
        along = w @ self.vectors
        return float(self.rest * (w @ w) + (self.values - self.rest) @ (along * along))


def shrunk_spectrum(x: np.ndarray) -> Spectrum:
    """shrunk_covariance(x) by the singular vectors of x: with fewer dates than stocks, no matrix of stocks by stocks is made."""
    n, p = x.shape
    x = x - x.mean(0)
    vectors, sizes, _ = np.linalg.svd(x.T, full_matrices=False)
    values = sizes**2 / n
    mu, squares = values.sum() / p, (values**2).sum()
    d2 = max(squares - p * mu * mu, 0.0) / p
    b2 = min(((np.einsum("ij,ij->i", x, x) ** 2).sum() / n - squares) / n / p, d2)
    shrink = b2 / d2 if d2 > 0 else 0.0
    return Spectrum(vectors, shrink * mu + (1 - shrink) * values, shrink * mu)


def markowitz(mu: np.ndarray, cov: np.ndarray | Spectrum, aversion: float = 1.0, cap: float = 0.05, cash: float = 0.0, long_only: bool = True, steps: int = 500) -> np.ndarray:
    """argmax mu.w - aversion * w'cov w with a budget and a cap, by accelerated projected gradients."""
    p, total = len(mu), 1 - cash
    cap = max(cap, total / p)
    low = 0.0 if long_only else -cap
    cov = Spectrum.of(cov)
    rate = 1 / max(2 * aversion * cov.largest(), 1e-12)
    cov = cov.at_least(1e-10)
    w = look = project(np.full(p, total / p), total, low, cap)
    along = along_look = w @ cov.vectors  # of both the parts along the eigenvectors, so that a step reads these twice
    excess = cov.values - cov.rest
    momentum = 1.0
    for _ in range(steps):
        new = project(look + rate * (mu - 2 * aversion * (cov.rest * look + cov.vectors @ (excess * along_look))), total, low, cap)
        along_new, moved = new @ cov.vectors, new - w
        if mu @ moved - 2 * aversion * (cov.rest * (new @ moved) + (excess * along_new) @ (along_new - along)) < 0:
            momentum = 1.0
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        share = (momentum - 1) / following
        look, along_look = new + share * moved, along_new + share * (along_new - along)
        w, along, momentum = new, along_new, following
    return w


def histories(rows: DataFrame, lookback: int, step: int, most: int | None = None) -> DataFrame:
    """at, n, score, past (the returns of the lookback dates before, the oldest first) of the valid stocks on every step-th date: all, or the best most by score. Histories are joined by ranges of dates."""
    chosen = rows.where(F.col("valid") & (F.col("t") % step == 0) & (F.col("t") >= lookback)).select(F.col("t").alias("at"), "n", "score")
    if most is not None:
        place = F.row_number().over(Window.partitionBy("at").orderBy(F.round("score", 9).desc(), F.col("n").desc()))
        chosen = chosen.withColumn("place", place).where(F.col("place") <= most).drop("place")
    reach = rows.select("t", "n", "ret", F.explode(F.sequence(F.floor(F.col("t") / step).cast("int") * step + step, F.floor((F.col("t") + lookback) / step).cast("int") * step, F.lit(step))).alias("at")).where("t < at and t >= at - %d" % lookback)
    past = F.array_sort(F.collect_list(F.struct("t", "ret")))
    return reach.join(chosen, ["at", "n"]).groupBy("at", "n", "score").agg(F.transform(past, lambda day: day["ret"]).alias("past"))


#: Parts that rebalance dates are dealt to: their sizes tell nothing of the time they take, so that none are put together.
PARTS = 128


def by_date(history: DataFrame, lookback: int, least: int, points: Callable[[np.ndarray, Spectrum], Iterator[tuple[float, np.ndarray]]]) -> DataFrame:
    """aversion, t, n, weight, expected, variance of the (aversion, weights) that points gives for each date's scores and covariance, over the stocks with a whole history."""

    def solve(table: pa.Table) -> pa.Table:
        table = table.filter(pc.equal(pc.list_value_length(table["past"]), lookback)).sort_by("n")
        made = []
        if len(table) >= least:
            past = np.concatenate([np.asarray(part.flatten()) for part in table["past"].chunks]).reshape(len(table), lookback)
            mu, stocks, at = table["score"].to_numpy(), table["n"].to_numpy(), table["at"][0].as_py()
            cov = shrunk_spectrum(past.T)
            for aversion, w in points(mu, cov):
                p = len(w)
                made.append(pa.table([pa.array(np.full(p, aversion)), pa.array(np.full(p, at), pa.int32()), pa.array(stocks, pa.int32()), pa.array(w), pa.array(np.full(p, mu @ w)), pa.array(np.full(p, cov.variance(w)))], POINTS.names))
        return pa.concat_tables(made) if made else POINTS.empty_table()

    return history.repartition(PARTS, "at").groupBy("at").applyInArrow(solve, "aversion double, t int, n int, weight double, expected double, variance double")


#: The columns of by_date().
POINTS = pa.schema([("aversion", pa.float64()), ("t", pa.int32()), ("n", pa.int32()), ("weight", pa.float64()), ("expected", pa.float64()), ("variance", pa.float64())])


def optimised(rows: DataFrame, aversions=(1.0,), cap: float = 0.05, lookback: int = 60, step: int = 20, least: int = 5, most: int | None = None) -> DataFrame:
    """aversion, t, n, weight, expected, variance: a frontier of portfolios on every step-th date (step=1: every one).

    rows: t, n, score, ret, valid. Dates are solved in parallel, each over all of its valid stocks, or over the best `most` by score.
    """
    return by_date(histories(rows, lookback, step, most), lookback, least, lambda mu, cov: ((aversion, markowitz(mu, cov, aversion, cap)) for aversion in aversions))


def diagonal_weights(scores: np.ndarray, history: np.ndarray, cap: float = 0.05, aversion: float = 1.0) -> np.ndarray:
    """Weights of candidates by their standardised scores over the deviations of their shrunk covariance, from the least of them on, capped; equal ones where there is nothing to tell them by."""
    equal = np.full(len(scores), 1 / max(1, len(scores)))
    mu = scores - scores.mean() if len(scores) else scores
    if len(scores) < 2 or not np.isfinite(mu).all() or mu.std() <= 1e-12:
        return equal
    variance = np.maximum(np.diag(shrunk_covariance(history)), 1e-8)
    raw = mu / mu.std() / np.sqrt(variance * max(aversion, 1e-8))
    raw -= raw.min()
    return capped(raw, max(cap, 1 / len(raw))) if np.isfinite(raw).all() and raw.sum() > 1e-12 else equal


def candidate_weights(rows: DataFrame, candidates: int = 50, window: int = 60, step: int = 20, cap: float = 0.05, aversion: float = 1.0) -> DataFrame:
    """t, n, weight: on every step-th date from window on, but for the last, the best candidates by diagonal_weights of their returns in the window before; held in between.

    rows: t, n, score, ret, valid. A date's candidates are chosen before their histories are joined, so that a task has candidates * window
    returns, whatever the number of stocks.
    """
    candidates, window, step = max(2, candidates), max(5, window), max(1, step)
    last = rows.agg(F.max("t").alias("last"))
    fine = F.col("valid") & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    dates = rows.where(fine & (F.col("t") % step == 0) & (F.col("t") >= window)).join(F.broadcast(last)).where("t < last")  # one row is broadcast
    place = F.row_number().over(Window.partitionBy("t").orderBy(F.round("score", 9).desc(), F.col("n").desc()))
    chosen = dates.select(F.col("t").alias("at"), "n", "score", place.alias("place")).where(F.col("place") <= candidates).drop("place")
    first, until = F.floor(F.col("t") / step).cast("int") * step + step, F.floor((F.col("t") + window) / step).cast("int") * step
    returns = F.when(F.isnan("ret") | F.col("ret").isNull() | (F.abs("ret") == float("inf")), 0.0).otherwise(F.col("ret"))
    reach = rows.select("t", "n", returns.alias("ret"), F.when(until >= first, F.sequence(first, until, F.lit(step))).alias("ats")).select("t", "n", "ret", F.explode("ats").alias("at"))
    history = reach.join(chosen, ["at", "n"]).groupBy("at", "n", "score").agg(F.array_sort(F.collect_list(F.struct("t", "ret"))).alias("past"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        x = np.array([[day["ret"] for day in past] for past in pdf["past"]]).T
        w = diagonal_weights(pdf["score"].to_numpy(float), x, cap, aversion)
        return pd.DataFrame({"at": pdf["at"], "n": pdf["n"], "weight": w})

    solved = history.groupBy("at").applyInPandas(solve, "at int, n int, weight double")
    marks = rows.select("t", "n").join(chosen.select(F.col("at").alias("t")).distinct().withColumn("turn", F.lit(True)), "t", "left")
    placed = marks.join(solved.withColumnRenamed("at", "t"), ["t", "n"], "left")
    held = F.last(F.when(F.col("turn"), F.coalesce("weight", F.lit(0.0))), ignorenulls=True).over(over_time())
    return placed.select("t", "n", F.coalesce(held, F.lit(0.0)).alias("weight"))


def block_bootstrap(curve: DataFrame, samples: int = 200, block: int = 20, seed: int = 0, periods: int = 252) -> DataFrame:
    """strategy and percentile bounds of the annualised return and of the Sharpe ratio, over resampled blocks of dates, cut to the length of the series. Starts are hashes: reruns agree."""
    size = curve.groupBy("strategy").agg(F.count("*").alias("size"), F.min("t").alias("first")).where("size >= 2").withColumn("block", F.least(F.lit(block), F.col("size")))
    draws = size.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / F.col("block")).cast("int") - 1)))
    number = F.conv(F.substring(F.md5(F.concat_ws("|", "strategy", "sample", "piece", F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("long")
    start = F.pmod(number, F.col("size") - F.col("block") + 1)
    picked = draws.select("strategy", "sample", "size", "first", (F.col("piece") * F.col("block")).alias("before"), F.posexplode(F.sequence(start, start + F.col("block") - 1)))
    cut = picked.where("before + pos < size").select("strategy", "sample", "size", (F.col("first") + F.col("col")).cast("int").alias("t"))
    rows = cut.join(curve.select("strategy", "t", "net"), ["strategy", "t"])
    each = rows.groupBy("strategy", "sample").agg((F.exp(F.sum(F.log1p(F.greatest("net", F.lit(-0.999999999)))) * periods / F.count("*")) - 1).alias("ann_return"), F.avg("net").alias("m"), F.stddev_samp("net").alias("s"))
    each = each.withColumn("sharpe", F.when(F.coalesce("s", F.lit(0.0)) < 1e-12, 0.0).otherwise(F.col("m") / F.greatest("s", F.lit(1e-300)) * F.sqrt(F.lit(float(periods)))))
    bounds = [F.percentile(c, p).alias(f"{c}_{name}") for c in ("ann_return", "sharpe") for name, p in (("low", 0.025), ("high", 0.975))]
    return each.groupBy("strategy").agg(*bounds)


def gated_equity(days: DataFrame, window: int = 3, least: float = 0.5) -> DataFrame:
    """t, ret, gate, equity of days (t, ret, level): a day counts if its level's share of rank among the last window rows is at least least."""
    w = Window.orderBy("t")  # a row per date: a calendar
    seen = F.collect_list("level").over(w.rowsBetween(1 - window, 0))
    gate = F.when(F.size(seen) == window, F.size(F.filter(seen, lambda v: v <= F.col("level"))) / float(window))
    gated = days.withColumn("gate", gate).withColumn("ret", F.when(F.col("gate") < least, 0.0).otherwise(F.col("ret")))
    return gated.select("t", "ret", "gate", F.exp(F.sum(F.log1p(F.greatest("ret", F.lit(-0.999999999)))).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("equity"))


def threshold_curve(rows: DataFrame, above: float = 0.5, most: float = 0.11, kept: float = 0.9989) -> DataFrame:
    """t, picked, factor, equity, equity_of_year of rows (t, date, prediction, ret): on each date half of the capital is in equal parts in the stocks predicted above a level, but for those whose return is most or more either way.

    The half that is invested loses 1 - kept to costs; a date without stocks changes nothing. Equities are sums of logarithms.
    """
    fine = (F.col("prediction") > above) & (F.abs("ret") < most)
    days = rows.groupBy("t", "date").agg(F.count(F.when(F.col("prediction") > above, 1)).alias("picked"), F.avg(F.when(fine, F.col("ret"))).alias("mean"))
    factor = F.when(F.col("mean").isNotNull(), 0.5 + 0.5 * kept * (1 + F.col("mean"))).otherwise(1.0)
    so_far = lambda *by: F.exp(F.sum(F.ln("factor")).over(Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    grown = days.withColumn("factor", factor).withColumn("year", F.year("date"))
    return grown.select("t", "picked", "factor", so_far(F.lit(0)).alias("equity"), so_far("year").alias("equity_of_year"))  # a row per date: a calendar


def walk_forward(n_dates: int, train: int, test: int, step: int) -> list[tuple[int, int, int, int]]:
    """(train start, train end, test start, test end) of rolling splits; ends are exclusive."""
    return [(at - train, at, at, min(at + test, n_dates - 1)) for at in range(train, n_dates - 1, step)]
