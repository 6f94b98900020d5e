"""Tickers and universes as tables: shapes of codes, the members that a table lists, presets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tickers of the presets.
US_LARGE = """
AAPL MSFT NVDA AMZN META GOOGL GOOG BRK-B LLY AVGO JPM TSLA UNH XOM V MA COST HD PG WMT
NFLX JNJ ABBV BAC KO ORCL CRM AMD MRK CVX PEP TMO ADBE LIN MCD CSCO ACN WFC ABT QCOM
IBM GE INTU DHR TXN AMGN PM NOW ISRG VZ CAT NEE DIS PFE RTX UBER GS SPGI LOW UNP
BKNG PGR T HON BLK TJX SYK ELV ETN LMT VRTX COP C MDT ADP MU CB ADI PANW REGN
APH BSX KLAC PLD AMT NOC DE GILD SO SCHW ANET ICE LRCX CME MO WM DUK MCO HCA SHW
""".split()
ETFS = """
SPY QQQ IWM DIA VTI VOO VEA VWO EFA EEM AGG BND TLT IEF SHY LQD HYG GLD SLV USO
XLF XLK XLE XLV XLY XLP XLI XLB XLU XLRE SMH SOXX ARKK VNQ IYR KRE XBI IBB TAN ICLN
EWT EWJ EWG EWU FXI MCHI INDA EWZ EWW EWC
""".split()
CN_LARGE = """
sh.600000 sh.600036 sh.600519 sh.600585 sh.600809 sh.600887 sh.601012 sh.601088 sh.601166 sh.601318
sh.601398 sh.601668 sh.601857 sh.601888 sh.601899 sz.000001 sz.000002 sz.000333 sz.000651 sz.000858
sz.002415 sz.002594 sz.300750 sz.300059 sz.300124
""".split()
PRESETS = {"us-large-100": US_LARGE, "etf-50": ETFS, "mixed-150": US_LARGE + ETFS, "cn-large-25": CN_LARGE}
#: Presets whose members only a table of an index can tell.
INDICES = ("csi-300", "hs300")

SHAPE = r"^(?:(sh|sz|bj)[.\s:_-]*)?([0-9]{6})(?:[.\s:_-]*(sh|sz|bj))?$"


def six_digits(code: Column) -> Column:
    """Six digits of 600519, SH600519, sh.600519, 600519.SH; null where none of these fits."""
    found = F.regexp_extract(F.lower(F.trim(code)), SHAPE, 2)
    return F.when(found != "", found)


def market(code: Column) -> Column:
    """sh, sz or bj: as the code has it, else by its first digit; null where it is no code."""
    lowered, digits = F.lower(F.trim(code)), six_digits(code)
    named = F.concat(F.regexp_extract(lowered, SHAPE, 1), F.regexp_extract(lowered, SHAPE, 3))
    first = F.substring(digits, 1, 1)
    guessed = F.when(first.isin("6", "9"), "sh").when(first.isin("4", "8"), "bj").otherwise("sz")
    return F.when(digits.isNotNull(), F.when(named != "", F.substring(named, 1, 2)).otherwise(guessed))


def dotted(code: Column) -> Column:
    """sh.600000 of sh.600000 and SH.600000; null where the market or the dot is missing."""
    lowered = F.lower(F.trim(code))
    return F.when(lowered.rlike(r"^(sh|sz)\.[0-9]{6}$"), lowered)


def normalised_tickers(codes: DataFrame) -> DataFrame:
    """code, ticker, market of codes (code), null where no shape fits."""
    return codes.select("code", six_digits(F.col("code")).alias("ticker"), market(F.col("code")).alias("market"))


def members(table: DataFrame) -> DataFrame:
    """stock: the codes of the column that has the most different ones, the first of equal columns."""
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.col(f"`{c}`").cast("string").alias("code")) for i, c in enumerate(table.columns)])
    listed = table.select(F.inline(cells)).select("place", six_digits(F.col("code")).alias("stock")).where("stock is not null").distinct()
    fullest = listed.groupBy("place").count().orderBy(F.desc("count"), "place").limit(1)
    return listed.join(F.broadcast(fullest), "place", "left_semi").select("stock")  # one row is broadcast


def first_with_members(tables: Mapping[str, DataFrame]) -> DataFrame:
    """origin, stock: the members of the first of these tables that lists any."""
    found = None
    for turn, (origin, table) in enumerate(tables.items()):
        one = members(table).select(F.lit(turn).alias("turn"), F.lit(origin).alias("origin"), "stock")
        found = one if found is None else found.union(one)
    first = found.agg(F.min("turn").alias("turn"))
    return found.join(F.broadcast(first), "turn", "left_semi").select("origin", "stock")


def universe(spark: SparkSession, preset: str, tickers: str = "", most: int | None = None, index: DataFrame | None = None, form=None) -> DataFrame:
    """turn, stock: tickers given by commas, else those of a preset, in order, most of them if it is given; an index preset takes its members, by code, from that table. form: six_digits or dotted."""
    given = [t.strip().upper() for t in tickers.split(",") if t.strip()]
    if not given and preset in INDICES:
        if index is None:
            raise ValueError(f"preset {preset!r} needs the table of the index")
        listed = members(index).select((F.row_number().over(Window.orderBy("stock")) - 1).alias("turn"), "stock")  # the members of one index
    else:
        listed = spark.createDataFrame(list(enumerate(given or PRESETS[preset])), "turn int, stock string")
    shaped = listed if form is None else listed.withColumn("stock", form(F.col("stock")))
    return shaped if most is None else shaped.where(F.col("turn") < most)
