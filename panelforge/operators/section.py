"""Operators over dates: targets, limit moves, neutralisation, breadth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelforge.plans import compiler, expr


def over_time() -> WindowSpec:
    return Window.partitionBy("n").orderBy("t")


def forward_return(panel: DataFrame, horizon: int = 1) -> DataFrame:
    """panel with target and target__m: the return from close to the close horizon rows on, where both are valid."""
    if horizon < 1:
        raise ValueError(f"a target lies ahead, not {horizon} rows")
    later, ok = F.lead("close", horizon).over(over_time()), F.col("mask") & F.lead("mask", horizon, False).over(over_time())
    out = panel.withColumns({"__later": later, "target__m": ok})
    return out.withColumn("target", F.when(F.col("target__m"), F.col("__later") / F.greatest("close", F.lit(1e-9)) - 1).otherwise(0.0)).drop("__later")


def previous_close(panel: DataFrame) -> Column:
    """last_close where the panel has it, else the close of the row before, in the first row its own."""
    return F.col("last_close") if "last_close" in panel.columns else F.coalesce(F.lag("close").over(over_time()), F.col("close"))


def limit_move_mask(panel: DataFrame, limit: float = 0.098, eps: float = 1e-3) -> DataFrame:
    """panel with free: valid cells, but for the first row's, whose close did not touch a price limit; by the limits where the panel has them, else by the size of the move from the previous close, valid or not."""
    free = F.abs(F.col("close") / F.greatest(previous_close(panel), F.lit(1e-9)) - 1) <= limit
    if "limit_up" in panel.columns and "limit_down" in panel.columns:
        banded = (F.col("limit_up") > 0) & (F.col("limit_down") > 0)
        by_band = (F.col("close") < F.col("limit_up") - eps) & (F.col("close") > F.col("limit_down") + eps)
        free = F.when(banded, by_band).otherwise(free)
    return panel.withColumn("__free", free).withColumn("free", F.col("__free") & F.col("mask") & (F.col("t") > 0)).drop("__free")


def neutralise_industry(rows: DataFrame, value: str, industry: str, mask: str = "mask", size: str | None = None) -> DataFrame:
    """rows with neutral: the residual of value on industries (and size) per date, over its population deviation.

    Residuals are by within-industry means; with a size, its slope on what the industries leave (Frisch-Waugh-Lovell).
    Fewer than two valid rows, or a residual deviation at most 1e-6 of the value's, give zeros.
    """
    of, at = Window.partitionBy("t", industry), Window.partitionBy("t")
    x = F.when(F.col(mask), F.col(value))
    out = rows.withColumn("__x", x).withColumn("__r", F.col("__x") - F.avg("__x").over(of))
    if size is not None:
        s = F.when(F.col(mask), F.col(size))
        out = out.withColumn("__s0", s).withColumn("__s", F.col("__s0") - F.avg("__s0").over(of))
        slope = F.sum(F.col("__r") * F.col("__s")).over(at) / F.greatest(F.sum(F.col("__s") * F.col("__s")).over(at), F.lit(1e-12))
        out = out.withColumn("__slope", slope).withColumn("__r", F.col("__r") - F.col("__slope") * F.col("__s"))
    out = out.withColumns({"__d": F.stddev_pop("__r").over(at), "__dx": F.stddev_pop("__x").over(at), "__n": F.count("__x").over(at)})
    fine = F.col(mask) & (F.col("__n") >= 2) & (F.col("__d") > 1e-6 * F.col("__dx"))
    return out.withColumn("neutral", F.when(fine, F.col("__r") / F.greatest("__d", F.lit(1e-300))).otherwise(0.0)).drop("__x", "__r", "__s", "__s0", "__slope", "__d", "__dx", "__n")


def bucket(ret: Column, truncate: bool = False) -> Column:
    """Per cent of a return, to the nearest even (or toward zero), within -10 to 10."""
    percent = F.greatest(F.least(ret * 100, F.lit(1e6)), F.lit(-1e6))
    whole = percent.cast("int") if truncate else F.bround(percent).cast("int")
    return F.greatest(F.least(whole, F.lit(10)), F.lit(-10))


def breadth(panel: DataFrame, truncate: bool = False) -> DataFrame:
    """t, family (CR: close returns, OR: opening gaps), bucket (-10 to 10), frac: the share of valid stocks.

    A close return without a valid previous close is 0. An opening gap counts unless there is no previous close: in the first
    row, or where last_close, if the panel has it, isn't over 0.
    """
    counted = breadth_counts(panel, truncate)
    return counted.select("t", "family", "bucket", (F.col("k") / F.sum("k").over(Window.partitionBy("t", "family"))).alias("frac"))


def breadth_counts(panel: DataFrame, truncate: bool = False) -> DataFrame:
    """t, family, bucket, k: see breadth()."""
    known = F.col("last_close") > 0 if "last_close" in panel.columns else F.col("t") > 0
    base = panel.withColumns({"__before": F.greatest(previous_close(panel), F.lit(1e-9)), "__ok": F.col("last_close") > 0 if "last_close" in panel.columns else F.lag("mask", 1, False).over(over_time())})
    close_ret = F.when(F.col("__ok"), F.col("close") / F.col("__before") - 1).otherwise(0.0)
    open_ret = F.col("open") / F.col("__before") - 1
    rows = base.where("mask").select("t", F.inline(F.array(F.struct(F.lit("CR").alias("family"), bucket(close_ret, truncate).alias("bucket")), F.struct(F.lit("OR").alias("family"), F.when(known, bucket(open_ret, truncate)).alias("bucket")))))
    return rows.where("bucket is not null").groupBy("t", "family", "bucket").agg(F.count("*").alias("k"))


def breadth_maps(panel: DataFrame, days: int = 20, truncate: bool = False) -> DataFrame:
    """t, family, today and recent: maps from bucket to the number of stocks, of the date and of the last `days` dates merged; buckets without stocks are no keys."""
    counted = breadth_counts(panel, truncate)
    own = counted.groupBy("t", "family").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "k")))).alias("today"))
    # a date's counts go to the dates that they count for, and are summed there by bucket: maps are made of sums, not of maps
    last = panel.agg(F.max("t")).first()[0]
    ahead = counted.withColumn("t", F.explode(F.sequence("t", F.least(F.col("t") + days - 1, F.lit(last)))))
    merged = ahead.groupBy("t", "family", "bucket").agg(F.sum("k").alias("k")).groupBy("t", "family").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "k")))).alias("recent"))
    return merged.join(own, ["t", "family"], "left").select("t", "family", F.coalesce("today", F.create_map().cast("map<int,bigint>")).alias("today"), "recent")


def merged_maps(a, b):
    """Column: a map of both maps' keys with the sums of their values."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def breadth_names() -> list[tuple[str, int, str]]:
    """Family, bucket and column (a minus sign as m) of the distributions."""
    return [(f, b, f"{f}_{'m' if b < 0 else ''}{abs(b)}") for f in ("CR", "OR") for b in range(-10, 11)]


def breadth_columns(panel: DataFrame) -> DataFrame:
    """A row per date with a column for every family and bucket."""
    found = breadth(panel)
    return found.groupBy("t").agg(*[F.coalesce(F.max(F.when((F.col("family") == f) & (F.col("bucket") == b), F.col("frac"))), F.lit(0.0)).alias(name) for f, b, name in breadth_names()])


def market_breadth(panel: DataFrame) -> DataFrame:
    """t, n and 48 columns: descending ranks of close, open, high, low, the mean price and the amount, null where the cell isn't valid, and the distributions of its date. A date is a row of a dimension, so that its columns are joined to the cells as such."""
    ranks = {"close": "close", "open": "open", "high": "high", "low": "low", "avg": "vwap", "amount": "amount"}
    values = {f"cs_rank_{name}": expr.cs_rank(expr.field(field), descending=True) for name, field in ranks.items()}
    ranked = compiler.evaluate(panel, values, 0)
    shares = breadth_columns(panel)
    zero = [F.coalesce(name, F.lit(0.0)).alias(name) for _, _, name in breadth_names()]
    return ranked.join(shares, "t", "left").select("t", "n", *values, *zero)
