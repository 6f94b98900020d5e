"""The panel: a dense grid of dates and stocks with a tradability mask.

Columns: t (int, the date's place), date, n (int, the stock's place), stock, open, high, low, close, volume, vwap,
amount, optionally limit_up, limit_down and last_close (double), mask (boolean, never null). A cell without a bar has
zeros and a false mask. Time windows partition by n, cross-sections by t.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close", "volume", "vwap")
OPTIONAL = ("amount", "limit_up", "limit_down", "last_close")

#: Names of a field in delimited inputs, in order of preference.
ALIASES = {
    "open": ("open", "S_FWDS_ADJOPEN", "OPEN"),
    "high": ("high", "S_FWDS_ADJHIGH", "HIGH"),
    "low": ("low", "S_FWDS_ADJLOW", "LOW"),
    "close": ("close", "S_FWDS_ADJCLOSE", "CLOSE"),
    "volume": ("volume", "S_DQ_VOLUME"),
    "vwap": ("vwap", "S_DQ_AVGPRICE"),
    "amount": ("amount", "S_DQ_AMOUNT", "AMOUNT"),
    "limit_up": ("limit_up", "LIMIT_UP", "S_DQ_LIMIT"),
    "limit_down": ("limit_down", "LIMIT_DOWN", "S_DQ_STOPPING"),
    "last_close": ("last_close", "LAST_CLOSE", "S_DQ_PRECLOSE"),
}


def priced_lines(lineitem: DataFrame, unit: str = "week") -> DataFrame:
    """date, stock and what a bar is made of, of the line items that count."""
    return lineitem.where((F.col("l_quantity") > 0) & F.col("l_shipdate").isNotNull()).select(
        F.date_trunc(unit, "l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("stock"), "l_quantity", "l_extendedprice", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"
    )


def aggregated(lines: DataFrame, *by: str) -> DataFrame:
    """Bars of priced_lines()."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    priced = lines.select(*by, price.alias("price"), "l_quantity", "l_extendedprice", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", price.alias("p")).alias("at"))
    bars = priced.groupBy(*by).agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"),
        F.sum("l_quantity").alias("volume"), F.round(F.sum("l_extendedprice"), 2).alias("amount"),
    )
    return bars.withColumn("vwap", F.col("amount") / F.col("volume"))


def trade_bars(lineitem: DataFrame, unit: str = "week") -> DataFrame:
    """Bars of suppliers from line items: date, stock, fields."""
    return aggregated(priced_lines(lineitem, unit), "date", "stock")


def trade_panel(lineitem: DataFrame, unit: str = "week") -> tuple[DataFrame, int]:
    """densify(trade_bars(lineitem)) by one exchange: lines are dealt by their stock's place, which bars, the empty cells between them and every window over time share.

    A bar is followed by the cells up to the stock's next one, so that nothing is joined but the calendar and the list of stocks, both broadcast as dimensions.
    """
    keys, spark = trade_keys(lineitem, unit), lineitem.sparkSession
    days = [r[0] for r in keys.select("date").distinct().orderBy("date").collect()]
    calendar = F.broadcast(spark.createDataFrame(list(enumerate(days)), "t int, date date"))
    stocks = keys.select("stock").distinct().select("stock", (F.row_number().over(Window.orderBy(F.asc_nulls_last("stock"))) - 1).cast("int").alias("n"))
    lines = priced_lines(lineitem, unit)
    dealt = lines.join(F.broadcast(stocks.withColumnRenamed("stock", "__stock")), F.col("stock").eqNullSafe(F.col("__stock"))).drop("__stock").repartition("n")
    placed = aggregated(dealt, "n", "stock", "date").join(calendar, "date").drop("date")
    w = Window.partitionBy("n").orderBy("t")
    first, until = F.when(F.lag("t").over(w).isNull(), 0).otherwise(F.col("t")), F.coalesce(F.lead("t").over(w), F.lit(len(days))) - 1
    cells = placed.withColumns({"__first": first, "__until": until}).withColumn("__at", F.explode(F.sequence("__first", "__until")))
    known = (F.col("__at") == F.col("t")) & F.col("stock").isNotNull()
    fields = [F.when(known, F.coalesce(F.col(c).cast("double"), F.lit(0.0))).otherwise(0.0).alias(c) for c in (*PRICES, "amount")]
    panel = cells.select(F.col("__at").alias("t"), "n", "stock", *fields, (known & F.col("close").isNotNull()).alias("mask"))
    if len(days) <= 1000 and days:
        dated = panel.withColumn("date", F.element_at(F.array(*[F.lit(d) for d in days]), F.col("t") + 1))
    else:
        dated = panel.join(calendar, "t")
    return dated.select("t", "date", "n", "stock", *PRICES, "amount", "mask"), len(days)


def order_bars(orders: DataFrame, customer: DataFrame, unit: str = "week") -> DataFrame:
    """Bars of nations from order totals."""
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    priced = joined.select(F.date_trunc(unit, "o_orderdate").cast("date").alias("date"), F.col("c_nationkey").alias("stock"), F.col("o_totalprice").alias("price"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    bars = priced.groupBy("date", "stock").agg(F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.count("*").cast("double").alias("volume"), F.round(F.sum("price"), 2).alias("amount"))
    return bars.withColumn("vwap", F.col("amount") / F.col("volume"))


def trade_keys(lineitem: DataFrame, unit: str = "week") -> DataFrame:
    """date, stock of the bars of line items, from two columns of the table."""
    fine = lineitem.where((F.col("l_quantity") > 0) & F.col("l_shipdate").isNotNull())
    return fine.select(F.date_trunc(unit, "l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("stock"))


def densify(bars: DataFrame, valid: str = "close is not null", keys: DataFrame | None = None, order: Sequence[str] | None = None) -> tuple[DataFrame, int]:
    """The panel of bars (date, stock, fields) and its number of dates. A calendar and a list of stocks are dimensions: both are small beside the bars.

    keys: what the dates and stocks are taken from, by default the bars; order: the stocks, by default all, by name.
    """
    keys = bars if keys is None else keys
    days = [r[0] for r in keys.select("date").distinct().orderBy("date").collect()]
    spark = bars.sparkSession
    calendar = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "t int, date date")
    if order is not None:
        stocks = spark.createDataFrame(list(enumerate(order)), "n int, stock string")
    else:
        stocks = keys.select("stock").distinct().withColumn("n", (F.row_number().over(Window.orderBy("stock")) - 1).cast("int"))
    # a join, not an exploded array: its size is known to be a product, so that no plan takes the grid for small and broadcasts it
    grid = stocks.crossJoin(F.broadcast(calendar))
    fields = [c for c in (*PRICES, *OPTIONAL) if c in bars.columns]
    marked = bars.select("date", "stock", *fields, F.expr(valid).alias("mask"))
    joined = grid.join(marked, ["date", "stock"], "left")
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in fields]
    if "amount" not in fields:
        filled.append((F.coalesce(F.col("vwap"), F.lit(0.0)) * F.coalesce(F.col("volume"), F.lit(0.0))).cast("double").alias("amount"))
    return joined.select("t", "date", "n", "stock", *filled, F.coalesce("mask", F.lit(False)).alias("mask")), len(days)


def resolve(columns: Sequence[str], field: str, required: bool = True) -> str | None:
    """The first alias of a field among columns."""
    found = next((a for a in ALIASES[field] if a in columns), None)
    if found is None and required:
        raise KeyError(f"none of {ALIASES[field]} is among the columns")
    return found


def in_file() -> Column:
    """Where a row of a delimited file stands."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())


def first_of_each(rows: DataFrame) -> DataFrame:
    """The first row, by at, of each date and stock."""
    first = Window.partitionBy("date", "stock").orderBy("at")
    return rows.withColumn("turn", F.row_number().over(first)).where("turn = 1").drop("turn", "at")


def load_csv(spark: SparkSession, path: str, sep: str = "\t", universe: Sequence[str] | None = None, date: str = "TRADE_DT", code: str = "S_INFO_WINDCODE") -> tuple[DataFrame, int]:
    """Panel of a delimited file with a header. Repeated (date, ticker) rows: the first in the file stays."""
    raw = spark.read.csv(path, sep=sep, header=True)
    for name in (date, code):
        if name not in raw.columns:
            raise KeyError(f"column {name} is missing")
    chosen = {f: resolve(raw.columns, f, f in PRICES) for f in (*PRICES, *OPTIONAL)}
    when = F.coalesce(F.try_to_timestamp(F.col(date), F.lit("yyyyMMdd")), F.try_to_timestamp(F.col(date), F.lit("yyyy-MM-dd"))).cast("date")
    fields = [F.expr(f"try_cast(`{c}` as double)").alias(f) for f, c in chosen.items() if c]
    rows = raw.select(when.alias("date"), F.substring(F.col(code), 1, 6).alias("stock"), *fields, in_file().alias("at"))
    if universe is not None:
        rows = rows.where(F.col("stock").isin([u[:6] for u in universe]))
    return densify(first_of_each(rows))


def load_plain_csv(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """date, open, high, low, close, volume, optionally symbol and vwap; vwap is (high + low + close) / 3 where it is missing."""
    raw = spark.read.csv(path, header=True, schema=None, inferSchema=False)
    number = lambda c: F.expr(f"try_cast(`{c}` as double)")
    rows = raw.select(F.to_date("date").alias("date"), (F.col("symbol") if "symbol" in raw.columns else F.lit("asset")).alias("stock"), *[number(c).alias(c) for c in ("open", "high", "low", "close", "volume")], (number("vwap") if "vwap" in raw.columns else F.lit(None).cast("double")).alias("vwap"), in_file().alias("at"))
    return densify(first_of_each(rows.withColumn("vwap", F.coalesce("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3))))


#: The columns of headerless inputs.
HEADERLESS = ("date", "stock", "open", "close", "high", "low", "vwap", "volume", "fhzs", "limit_up", "limit_down", "last_close")


def load_headerless(spark: SparkSession, path: str, sep: str = "\t") -> tuple[DataFrame, int]:
    schema = ", ".join(f"{c} {'string' if c in ('date', 'stock') else 'double'}" for c in HEADERLESS)
    raw = spark.read.csv(path, sep=sep, schema=schema).select(*HEADERLESS, in_file().alias("at"))
    rows = raw.withColumn("date", F.to_date("date", "yyyyMMdd")).withColumn("amount", F.col("volume") * F.col("vwap"))
    return densify(first_of_each(rows))


def violations(panel: DataFrame) -> DataFrame:
    """Valid cells whose high is below, or whose low is above, another price."""
    return panel.where(F.col("mask") & ((F.col("high") < F.greatest("open", "low", "close")) | (F.col("low") > F.least("open", "high", "close"))))


def with_returns(panel: DataFrame) -> DataFrame:
    """panel with ret and ret__m: against last_close where the panel has it, else against the row before."""
    w = Window.partitionBy("n").orderBy("t")
    if "last_close" in panel.columns:
        base, valid = F.greatest("last_close", F.lit(1e-9)), F.col("mask") & (F.col("last_close") > 0)
    else:
        base, valid = F.greatest(F.lag("close", 1, 0.0).over(w), F.lit(1e-9)), F.col("mask") & F.lag("mask", 1, False).over(w)
    out = panel.withColumns({"__base": base, "ret__m": valid})
    return out.withColumn("ret", F.when(F.col("ret__m"), F.col("close") / F.col("__base") - 1).otherwise(0.0)).drop("__base")


def coverage(panel: DataFrame) -> DataFrame:
    """Per stock: cells, valid cells, their share, first and last valid date."""
    valid = F.when(F.col("mask"), F.col("t"))
    return panel.groupBy("n").agg(F.count("*").alias("cells"), F.count(valid).alias("valid"), F.avg(F.col("mask").cast("double")).alias("share"), F.min(valid).alias("first_t"), F.max(valid).alias("last_t"))


def universe(panel: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of stocks that are in members (stock)."""
    return panel.join(members.select("stock").distinct(), "stock", "left_semi")


def between(panel: DataFrame, first: int, last: int) -> DataFrame:
    """Rows with first <= t < last."""
    return panel.where((F.col("t") >= first) & (F.col("t") < last))
