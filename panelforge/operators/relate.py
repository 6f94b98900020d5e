"""Relational operators over bars and events: shifted and as-of joins, segments, neighbours, yearly figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_row_join(bars: DataFrame, columns: list[str]) -> DataFrame:
    """Bars with columns of the stock's next bar, as next_*; within a stock only."""
    w = Window.partitionBy("stock").orderBy("date")
    return bars.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})


def as_of(facts: DataFrame, snapshots: DataFrame, value: str) -> DataFrame:
    """facts (date, stock) with the value of the last snapshot (date, stock, value) at or before the date.

    Both sides are one union, and the value is carried forward along it: one exchange, and no range join.
    """
    marks = snapshots.select("date", "stock", F.col(value).alias("__value"), F.lit(0).alias("__fact"))
    rows = facts.withColumns({"__value": F.lit(None).cast(snapshots.schema[value].dataType), "__fact": F.lit(1)})
    w = Window.partitionBy("stock").orderBy("date", "__fact").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.unionByName(marks, allowMissingColumns=True).withColumn(value, F.last("__value", ignorenulls=True).over(w))
    return carried.where("__fact = 1").drop("__fact", "__value")


def expand_snapshots(snapshots: DataFrame, until) -> DataFrame:
    """A row per stock and day from each snapshot to the day before the next, or to until."""
    w = Window.partitionBy("stock").orderBy("date")
    last = F.coalesce(F.date_sub(F.lead("date").over(w), 1), F.lit(until).cast("date"))
    ranged = snapshots.withColumn("__last", last).where("__last >= date")
    return ranged.withColumn("date", F.explode(F.sequence("date", "__last"))).drop("__last")


def segments(bars: DataFrame, gap_days: int = 10) -> DataFrame:
    """bars with seg: a stock's history breaks where more than gap_days lie between bars."""
    w = Window.partitionBy("stock").orderBy("date")
    apart = F.datediff("date", F.lag("date").over(w))
    return bars.withColumn("__new", F.when(apart > gap_days, 1).otherwise(0)).withColumn("seg", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def segment_panel(bars: DataFrame, gap_days: int = 10) -> DataFrame:
    """bars (date, stock, prices, volume, vwap) as histories of their own between gaps: seg, pos (a row's number in its segment) and mask.

    For compiler.evaluate(date="date", stock="stock, seg", at="pos"): windows and their masks begin anew at each break, sections
    are of a date's stocks.
    """
    own = Window.partitionBy("stock", "seg").orderBy("date")
    return segments(bars, gap_days).withColumns({"pos": F.row_number().over(own) - 1, "mask": F.col("close").isNotNull()})


def with_neighbour(bars: DataFrame, relations: DataFrame, columns: list[str]) -> DataFrame:
    """Bars with same-day columns of the stock's most related stock, as near_*. relations: stock1, stock2, rel."""
    best = Window.partitionBy("stock1").orderBy(F.desc("rel"), F.asc("stock2"))
    top = relations.withColumn("__place", F.row_number().over(best)).where("__place = 1").select(F.col("stock1").alias("stock"), F.col("stock2").alias("near"))
    return with_top_neighbour(bars, top, columns)


def with_top_neighbour(bars: DataFrame, top: DataFrame, columns: list[str]) -> DataFrame:
    """Bars with same-day columns, as near_*, of the one neighbour that top (stock, near) has for a stock."""
    other = bars.select(F.col("stock").alias("near"), "date", *[F.col(c).alias(f"near_{c}") for c in columns])
    return bars.join(top, "stock", "left").join(other, ["near", "date"], "left")


def nearest(stocks: DataFrame, group: str, value: str) -> DataFrame:
    """stock, near: the stock of the same group whose value is nearest, the smaller of equally near ones; none for a stock by itself.

    stocks: stock, a group, a value. Along a group's distinct values only the one before, the value itself and the one after are
    candidates (unlike numbers so far from each other that their differences are rounded alike count as apart): no pairs are made. As
    in an order of differences, what isn't a number comes first and a missing value last.
    """
    number = F.col(value).isNotNull() & ~F.isnan(value)
    two = lambda when: F.slice(F.array_sort(F.collect_set(F.when(when, F.col("stock")))), 1, 2)  # noqa: E731  # one more than is needed, as a stock isn't its own neighbour
    fine = stocks.where(F.col(group).isNotNull() & F.col("stock").isNotNull())
    points = fine.where(number).groupBy(group, value).agg(two(F.lit(True)).alias("own"))
    w = Window.partitionBy(group).orderBy(value)
    around = points.select(group, value, F.col("own").alias("__same"), F.array(*[F.struct(f(value).alias("v"), f("own").alias("own")) for f in (lambda c: F.lag(c).over(w), F.col, lambda c: F.lead(c).over(w))]).alias("__sides"))
    beside = fine.groupBy(group).agg(two(F.isnan(value)).alias("__odd"), two(F.col(value).isNotNull()).alias("__known"), two(F.lit(True)).alias("__any"))
    joined = fine.join(around, [group, value], "left").join(F.broadcast(beside), group)  # a row for each group, such as a nation
    other = lambda a: F.get(F.filter(a, lambda x: x != F.col("stock")), F.lit(0))
    placed = lambda place, stock: F.when(stock.isNotNull(), F.struct(F.lit(place).alias("place"), F.lit(0.0).alias("apart"), stock.alias("stock")))
    sides = F.filter(F.transform("__sides", lambda p: F.struct(F.lit(1).alias("place"), F.abs(F.col(value) - p["v"]).alias("apart"), other(p["own"]).alias("stock"))), lambda p: p["stock"].isNotNull())
    endless = F.abs(value) == float("inf")
    found = (
        F.when(F.col(value).isNull(), placed(2, other(F.col("__any"))))
        .when(F.isnan(value), F.coalesce(placed(0, other(F.col("__known"))), placed(2, other(F.col("__any")))))
        .when(endless, F.coalesce(placed(0, other(F.array_sort(F.array_union("__odd", "__same")))), placed(1, other(F.col("__known"))), placed(2, other(F.col("__any")))))
        .otherwise(F.coalesce(placed(0, other(F.col("__odd"))), F.array_min(sides), placed(2, other(F.col("__any")))))
    )
    return joined.groupBy("stock").agg(F.min(found)["stock"].alias("near")).where("near is not null")


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order: a deterministic DISTINCT ON."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def head_per_date(rows: DataFrame, score: str, target: str, sizes=(1, 5, 10)) -> DataFrame:
    """size, mean and hit rate of the target among each date's best rows, for several sizes at once."""
    w = Window.partitionBy("t").orderBy(F.round(score, 9).desc(), F.asc("n"))
    placed = rows.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= max(sizes))
    grid = placed.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where("__place <= size")
    return grid.groupBy("size").agg(F.avg(target).alias("mean"), F.avg((F.col(target) > 0).cast("double")).alias("hit_rate"), F.count("*").alias("rows"))


def threshold_sweep(rows: DataFrame, score: str, target: str, levels) -> DataFrame:
    """level, rows and mean target of the rows whose score is above each level."""
    grid = rows.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels]))).where(F.col(score) > F.col("level"))
    return grid.groupBy("level").agg(F.count("*").alias("rows"), F.avg(target).alias("mean"))


def yearly(curve: DataFrame) -> DataFrame:
    """Per strategy and year: compounded return and annualised Sharpe ratio of a dated series (strategy, date, net)."""
    rows = curve.withColumn("year", F.year("date"))
    out = rows.groupBy("strategy", "year").agg(F.count("*").alias("n"), (F.exp(F.sum(F.log1p("net"))) - 1).alias("ret"), F.avg("net").alias("m"), F.stddev_samp("net").alias("s"))
    return out.select("strategy", "year", "n", "ret", F.when(F.coalesce("s", F.lit(0.0)) < 1e-12, 0.0).otherwise(F.col("m") / F.greatest("s", F.lit(1e-300)) * F.sqrt(F.col("n").cast("double"))).alias("sharpe"))


def demean(rows: DataFrame, column: str) -> DataFrame:
    """rows with the column less its mean of the date."""
    return rows.withColumn(column, F.col(column) - F.avg(column).over(Window.partitionBy("t")))


def leaderboard(reports: DataFrame) -> DataFrame:
    """source, preset, strategy and figures of report documents (metadata, results), best first, unknown Sharpe ratios last."""
    flat = reports.select("metadata.source", "metadata.preset", F.explode("results").alias("r")).select("source", "preset", "r.*")
    return flat.orderBy(F.col("sharpe").desc_nulls_last(), "strategy", "source")


def with_dimension(rows: DataFrame, dimension: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of a dimension with the rows that have its keys: the right outer join."""
    return rows.join(dimension, keys, "right")


def before_row(rows: DataFrame, column: str, window: int) -> DataFrame:
    """rows with the mean, deviation, sum and least of a column over the window rows before, without the row itself; of those there are."""
    w = Window.partitionBy("n").orderBy("t").rowsBetween(-window, -1)
    return rows.withColumns({f"{column}_{name}": f(column).over(w) for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("sum", F.sum), ("min", F.min))})


def rolling_apply(rows: DataFrame, column: str, window: int | None, function, least: int = 1) -> DataFrame:
    """rows with applied: function (an array Column to a Column) of the known values among the last window rows, all of them for None, null for fewer than least."""
    w = Window.partitionBy("n").orderBy("t").rowsBetween(Window.unboundedPreceding if window is None else 1 - window, 0)
    return rows.withColumn("__seen", F.collect_list(column).over(w)).withColumn("applied", F.when(F.size("__seen") >= least, function(F.col("__seen")))).drop("__seen")
