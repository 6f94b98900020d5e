"""A synthetic panel: a one-factor random walk with halts and price limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Market:
    """The defaults of the demonstration panel."""

    stocks: int = 200
    dates: int = 500
    start: str = "2020-01-02"
    drift: float = 0.05
    volatility: float = 0.30
    beta: float = 0.6
    halt: float = 0.005
    limit: float = 0.10
    seed: int = 42


def noise(*keys) -> F.Column:
    """A standard normal number made from hashes of keys: it depends on no partition, and reruns agree."""
    unit = lambda salt: (F.pmod(F.xxhash64(*keys, F.lit(salt)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.ln(unit(1))) * F.cos(2 * 3.141592653589793 * unit(2))


def synthetic_panel(spark: SparkSession, market: Market = Market()) -> tuple[DataFrame, int]:
    m, day = market, 1 / 252
    sd = m.volatility * day**0.5
    at = lambda name: noise(F.lit(m.seed), F.lit(name), F.col("t"), F.col("n"))
    weeks = F.expr(f"filter(sequence(date'{m.start}', date_add(date'{m.start}', {m.dates * 2 + 10})), d -> weekday(d) < 5)")
    grid = spark.range(m.stocks).select(F.col("id").cast("int").alias("n"), F.posexplode(F.slice(weeks, 1, m.dates)).alias("t", "date"))
    shock = m.beta * noise(F.lit(m.seed), F.lit("market"), F.col("t")) + (1 - m.beta**2) ** 0.5 * at("own")
    edge = F.log1p(F.lit(m.limit * 0.999))
    step = F.greatest(F.least(m.drift * day + sd * shock, edge), -edge)
    w = Window.partitionBy("n").orderBy("t")
    start = 10 + 90 * F.pmod(F.xxhash64(F.lit(m.seed), "n"), F.lit(1000)) / 1000
    rows = grid.withColumn("close", F.round(start * F.exp(F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0))), 4))
    rows = rows.withColumn("open", F.round(F.col("close") * F.exp(0.3 * sd * at("open")), 4))
    rows = rows.withColumns({"high": F.greatest("open", "close") * (1 + 0.3 * sd * F.abs(at("high"))), "low": F.least("open", "close") * (1 - F.least(F.lit(0.5), 0.3 * sd * F.abs(at("low"))))})
    rows = rows.withColumn("mask", F.pmod(F.xxhash64(F.lit(m.seed), F.lit("halt"), "t", "n"), F.lit(1_000_000)) >= m.halt * 1_000_000)
    rows = rows.withColumns({"vwap": (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4, "volume": F.when(F.col("mask"), F.exp(12 + 0.5 * at("volume"))).otherwise(0.0), "last_close": F.lag("close", 1).over(w)})
    rows = rows.withColumn("last_close", F.coalesce("last_close", "open"))
    rows = rows.withColumns({"amount": F.col("vwap") * F.col("volume"), "limit_up": F.round(F.col("last_close") * (1 + m.limit), 2), "limit_down": F.round(F.col("last_close") * (1 - m.limit), 2)})
    return rows.withColumn("stock", F.format_string("S%05d", "n")), m.dates
