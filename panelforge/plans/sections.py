"""Primitives over a date whose stocks are too many for one task.

A window over a date has all of its stocks in one task. Here a z-score or a scale takes its date's figures from an
aggregation, combined before the exchange, whose rows (one for each date) are broadcast; the panel itself isn't shuffled. Ranks count
the cells of each distinct value, place the values in ranges by quantiles of their date, count within a range, and carry
on by the totals of the ranges before; the ranks are joined to the cells by date and value. Values that many cells have
are few, and are broadcast. All give what the windows give.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a date's values; a value of at least this share of all cells is joined by a broadcast, at most 1 / HOT values.
RANGES, HOT = 64, 0.001


def figures(rows: DataFrame, date: str, wanted: dict[str, str], finished: dict[str, str], store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with columns by expressions (finished) over their date's aggregates (wanted)."""
    of_date = store(rows.groupBy(F.col(date).alias("__t")).agg(*[F.expr(e).alias(name) for name, e in wanted.items()]))
    joined = rows.join(F.broadcast(of_date), F.col(date) == F.col("__t"))  # a row for each date of the calendar
    return joined.selectExpr("*", *[f"{e} AS {name}" for name, e in finished.items()]).drop("__t", *wanted)


def ranks(rows: DataFrame, date: str, stock: str, wanted: dict[str, tuple[str, str, bool]], store: Callable[[DataFrame], DataFrame], ranges: int = RANGES) -> DataFrame:
    """rows with columns of average ranks over their number, among the valid cells of their date; wanted: mask, key and whether they descend, by column."""
    keyed = rows.selectExpr("*", *[f"IF({m}, {'-' if descending else ''}({key}), NULL) AS __key_{name}" for name, (m, key, descending) in wanted.items()])
    cells = keyed.select(F.col(date).alias("__t"), F.inline(F.array(*[F.struct(F.lit(name).alias("__of"), F.col(f"__key_{name}").alias("__key")) for name in wanted])))
    counted = cells.where("__key IS NOT NULL").groupBy("__t", "__of", "__key").agg(F.count("*").alias("__k"))
    bounds = counted.groupBy("__t", "__of").agg(F.percentile_approx("__key", [i / ranges for i in range(1, ranges)], 1000).alias("__bounds"))
    within = F.size(F.filter("__bounds", lambda v: v < F.col("__key")))
    # stored, as the bounds of a second run could be others
    placed = store(counted.join(bounds, ["__t", "__of"]).withColumn("__range", within).drop("__bounds"))
    before = Window.partitionBy("__t", "__of").orderBy("__range")
    totals = placed.groupBy("__t", "__of", "__range").agg(F.sum("__k").alias("__n"))
    offsets = totals.select("__t", "__of", "__range", (F.sum("__n").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"), F.sum("__n").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__all"))
    inside = F.sum("__k").over(Window.partitionBy("__t", "__of", "__range").orderBy("__key").rowsBetween(Window.unboundedPreceding, 0))
    ranked = store(placed.withColumn("__inside", inside).join(offsets, ["__t", "__of", "__range"]).select("__t", "__of", "__key", "__k", ((F.col("__before") + F.col("__inside") - (F.col("__k") - 1) / 2.0) / F.col("__all")).alias("__rank")))
    found = keyed
    for name, (m, _, _) in wanted.items():
        own = ranked.where(F.col("__of") == name).select(F.col("__t").alias("__day"), F.col("__key").alias("__same"), "__k", "__rank", F.lit(0).cast("long").alias("__zero"))
        enough = HOT * (own.agg(F.sum("__k")).first()[0] or 0)
        frequent, others = own.where(F.col("__k") >= enough), own.where(F.col("__k") < enough)
        key, day = F.col(f"__key_{name}"), F.col(date) == F.col("__day")
        found = found.join(F.broadcast(frequent.select("__day", "__same", F.col("__rank").alias("__often"))), day & (key == F.col("__same")), "left").drop("__day", "__same")
        # cells of frequent values and those without one join nothing more, and are dealt by their stock
        found = found.withColumns({"__rest": F.when(F.col("__often").isNull(), key)}).withColumn("__salt", F.when(F.col("__rest").isNull(), F.xxhash64(*stock.split(", "))).otherwise(0))
        same = day & (F.coalesce("__rest", F.lit(0.0)) == F.col("__same")) & (F.col("__salt") == F.col("__zero")) & F.col("__rest").isNotNull()
        found = found.join(others.select("__day", "__same", "__zero", "__rank"), same, "left")
        found = found.selectExpr("*", f"IF({m}, coalesce(__often, __rank), 0D) AS {name}").drop("__day", "__same", "__zero", "__rank", "__often", "__rest", "__salt", f"__key_{name}")
    return found
