"""Signals of a stock's last rows as vectors: momentum, changes from row to row, ranks within the window, trends and stochastics.

A window is k consecutive valid rows of a stock, oldest first; rows without one have no signals. Each vector is an array
column, made by array functions from the window's fields, which are gathered once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("open", "high", "low", "close", "volume")


def windows(panel: DataFrame, k: int = 21, stock: str = "n", at: str = "t") -> DataFrame:
    """stock, at and an array of k values for each field, of rows that end k consecutive valid ones."""
    frame = f"OVER (PARTITION BY {stock} ORDER BY {at} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    gathered = panel.selectExpr(at, stock, f"collect_list(struct({', '.join(FIELDS)})) {frame} AS seen", f"count(IF(mask, 1, NULL)) {frame} AS valid")
    full = gathered.where(F.col("valid") == k)
    return full.select(at, stock, *[F.col(f"seen.{f}").alias(f) for f in FIELDS])


def momentum(x: Column, k: int) -> Column:
    """Logarithm of the newest value over each older one."""
    return F.transform(F.slice(x, 1, k - 1), lambda v: F.ln(F.element_at(x, -1) / v))


def mean_momentum(x: Column, k: int) -> Column:
    """Logarithm of the newest value over the means of the last 2, 3, ..., k."""
    last = lambda j: F.slice(x, k - j + 1, j)
    return F.transform(F.sequence(F.lit(2), F.lit(k)), lambda j: F.ln(F.element_at(x, -1) * j / F.aggregate(last(j), F.lit(0.0), lambda a, v: a + v)))


def changes(x: Column, y: Column, k: int) -> Column:
    """Logarithm of each y over the x of the row before."""
    return F.zip_with(F.slice(x, 1, k - 1), F.slice(y, 2, k - 1), lambda a, b: F.ln(b / a))


def rises(x: Column, y: Column, k: int) -> Column:
    """1 where y is above the x of the row before."""
    return F.zip_with(F.slice(x, 1, k - 1), F.slice(y, 2, k - 1), lambda a, b: (b > a).cast("int"))


def stochastics(high: Column, low: Column, close: Column, k: int, least: float = 1e-4) -> Column:
    """Where each close from the second on is between the lowest low (0) and the highest high (1) so far; 0 where they are hardly apart."""

    def of(i: Column) -> Column:
        top, bottom = F.array_max(F.slice(high, F.lit(1), i)), F.array_min(F.slice(low, F.lit(1), i))
        return F.when(top - bottom < least, 0.0).otherwise((F.element_at(close, i) - bottom) / (top - bottom))

    return F.transform(F.sequence(F.lit(2), F.lit(k)), of)


def ranked(rows: DataFrame, field: str, k: int, ahead: int = 6) -> DataFrame:
    """rows with the rank system of a field's window.

    order: the rows' numbers (0 is the oldest) by value, of equal ones the older first; ranks: each row's place in it; since_low and
    since_high: rows since the lowest and the highest, the newest being 1; to_low, to_high, to_middle, to_upper: logarithms of
    the newest over the lowest, the highest and the two middle values; up and down: logarithms of the next larger values
    over the newest, and of the newest over the next smaller ones, `ahead` of each, 0 where there are fewer.
    """
    x = F.col(field)
    numbered = F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    placed = rows.withColumn("__sorted", F.array_sort(numbered)).withColumn("order", F.transform("__sorted", lambda s: s["i"]))
    placed = placed.withColumns({"ranks": F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.array_position("order", i).cast("int") - 1), "__at": F.array_position("order", F.lit(k - 1)).cast("int")})
    value = lambda i: F.get(F.transform("__sorted", lambda s: s["v"]), i)
    newest = F.element_at(x, -1)
    steps = F.sequence(F.lit(1), F.lit(ahead))
    at = F.col("__at") - 1
    return placed.withColumns({
        "since_low": k - F.get("order", F.lit(0)), "since_high": k - F.get("order", F.lit(k - 1)),
        "to_low": F.ln(newest / value(F.lit(0))), "to_high": F.ln(newest / value(F.lit(k - 1))), "to_middle": F.ln(newest / value(F.lit(k // 2))), "to_upper": F.ln(newest / value(F.lit(k // 2 + 1))),
        "up": F.transform(steps, lambda j: F.coalesce(F.ln(value(at + j) / newest), F.lit(0.0))),
        "down": F.transform(steps, lambda j: F.when(at - j >= 0, F.ln(newest / value(F.greatest(at - j, F.lit(0))))).otherwise(0.0)),
    }).drop("__sorted", "__at")


def signals(panel: DataFrame, k: int = 21, ahead: int = 6, field: str = "close") -> DataFrame:
    """t, n and the vectors of every full window: momenta of all fields, changes, rises, stochastics, and the rank system of one field."""
    seen = windows(panel, k)
    o, h, lo, c, _ = (F.col(f) for f in FIELDS)
    vectors = {f"momentum_{f}": momentum(F.col(f), k) for f in FIELDS} | {f"mean_momentum_{f}": mean_momentum(F.col(f), k) for f in FIELDS}
    vectors |= {"close_to_close": changes(c, c, k), "open_to_open": changes(o, o, k), "open_to_close": changes(o, c, k), "high_to_close": changes(h, c, k), "rises": rises(c, c, k), "rises_over_open": rises(o, c, k), "stochastics": stochastics(h, lo, c, k)}
    return ranked(seen.withColumns(vectors), field, k, ahead).drop(*FIELDS)
