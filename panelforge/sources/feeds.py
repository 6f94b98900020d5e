"""Panels of daily bars as data services return them, and one way to any source.

The services themselves need a network, which is left to the caller: these functions take the rows they return, as tables, or a
function that fetches a ticker's rows, which the tasks call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from panelforge.sources import panel as panels
from panelforge.sources import universes
from panelforge.sources.synthetic import Market, synthetic_panel

#: What a service calls the columns of a bar.
TITLED = {"Date": "date", "Ticker": "code", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume"}
CHINESE = {"日期": "date", "开盘": "open", "收盘": "close", "最高": "high", "最低": "low", "成交量": "volume", "成交额": "amount"}
NEEDED = ("date", "code", "open", "high", "low", "close", "volume")


def bars_of(rows: DataFrame, names: dict[str, str], extra: Sequence[str] = ()) -> DataFrame:
    """date, stock, numbers (what is none is null) and the mean of the four prices as vwap."""
    renamed = rows.withColumnsRenamed({old: new for old, new in names.items() if old in rows.columns})
    missing = [c for c in (*NEEDED, *extra) if c not in renamed.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    numbers = [F.expr(f"try_cast(`{c}` as double)").alias(c) for c in (*NEEDED[2:], *extra)]
    kept = renamed.select(F.to_date("date").alias("date"), F.col("code").cast("string").alias("stock"), *numbers, *([F.col("tradestatus").cast("string").alias("tradestatus")] if "tradestatus" in renamed.columns else []))
    return kept.withColumn("vwap", (F.col("open") + F.col("close") + F.col("high") + F.col("low")) / 4)


#: All of a bar is there.
WHOLE = "open is not null and high is not null and low is not null and close is not null and volume is not null"


def titled_panel(rows: DataFrame, tickers: Sequence[str]) -> tuple[DataFrame, int]:
    """Panel of Date, Ticker, Open, High, Low, Close, Volume, in the order of the tickers; one without rows has invalid cells only."""
    return panels.densify(wanted(bars_of(rows, TITLED), tickers), WHOLE, order=tickers)


def status_panel(rows: DataFrame, tickers: Sequence[str], proxy_vwap: bool = True) -> tuple[DataFrame, int]:
    """Panel of date, code, prices, volume, amount, preclose, tradestatus: valid where the status is 1, with preclose as last_close."""
    if not proxy_vwap:
        raise ValueError("prices are adjusted and amounts aren't: the mean price is the only vwap on one basis")
    tickers = listed(rows.sparkSession, tickers, universes.dotted)
    bars = bars_of(rows.withColumnRenamed("preclose", "last_close"), {}, ("amount", "last_close"))
    return panels.densify(wanted(bars, tickers), f"{WHOLE} and coalesce(tradestatus, '0') = '1'", order=tickers)


def chinese_panel(rows: DataFrame, tickers: Sequence[str]) -> tuple[DataFrame, int]:
    """Panel of rows with Chinese column names and code."""
    tickers = listed(rows.sparkSession, tickers, universes.six_digits)
    bars = wanted(bars_of(rows, CHINESE, ("amount",)), tickers)
    if bars.isEmpty():
        raise ValueError(f"no data for tickers {tickers}")
    return panels.densify(bars, WHOLE, order=tickers)


def listed(spark: SparkSession, tickers: Iterable[str], form: Callable[[Column], Column]) -> list[str]:
    """A caller's tickers in that form, in order, each once; what has none is an error."""
    given = spark.createDataFrame([(i, str(t)) for i, t in enumerate(tickers)], "i long, code string")
    found = given.where(F.trim("code") != "").select("i", "code", form(F.col("code")).alias("ticker")).orderBy("i").collect()
    wrong = [r["code"] for r in found if r["ticker"] is None]
    if wrong:
        raise ValueError(f"no tickers of this service: {wrong[:5]}")
    return list(dict.fromkeys(r["ticker"] for r in found))


def wanted(bars: DataFrame, tickers: Sequence[str]) -> DataFrame:
    few = bars.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(tickers)], "stock string")
    return bars.join(few, "stock", "left_semi")


def downloaded(codes: DataFrame, fetch: Callable[[str], Iterable[dict]], schema: str, waits: Sequence[float] = (0.5, 1.0, 2.0)) -> DataFrame:
    """code, the fields of schema and error: what fetch returns for each of codes (code), asked by the tasks.

    A call that fails is made again after each of waits seconds. A code whose last call fails has one row with the error and null fields.
    """
    of_rows = to_arrow_schema(T.StructType.fromDDL(f"code string, {schema}, error string"))

    def rows_of(code: str) -> list[dict]:
        import time

        for wait in (*waits, None):
            try:
                return [{**row, "code": code, "error": None} for row in fetch(code)]
            except Exception as error:  # noqa: BLE001 what a service raises isn't known
                if wait is None:
                    return [{"code": code, "error": f"{type(error).__name__}: {error}"}]
            time.sleep(wait)
        return []

    def run(batches):
        for batch in batches:
            found = [row for code in batch.column(0).to_pylist() for row in rows_of(code)]
            yield pa.RecordBatch.from_pylist(found, schema=of_rows)

    return codes.select(F.col("code").cast("string")).mapInArrow(run, f"code string, {schema}, error string")


def merged_downloads(bulk: DataFrame, retried: DataFrame) -> DataFrame:
    """Rows (date, code, ...) of a bulk download, and of a second one those whose ticker has no row with a close in the first."""
    known = bulk.where("close is not null").select("code").distinct()
    return bulk.join(known, "code", "left_semi").unionByName(retried.join(known, "code", "left_anti"), allowMissingColumns=True)


def reprojected(spark: SparkSession, path: str, columns: dict[str, str], sep: str = ",", to: str = "\t") -> DataFrame:
    """Named columns of a headerless wide file, by expressions over _c0, _c1, ..., as one delimited line each."""
    raw = spark.read.csv(path, sep=sep)
    return raw.select(F.concat_ws(to, *[F.expr(e).cast("string") for e in columns.values()]).alias("value"))


def make_panel(spark: SparkSession, source: str = "synthetic", **options) -> tuple[DataFrame, int]:
    """The panel of a source: synthetic (Market's fields), csv (path), parquet (path: date, stock, fields), or titled, status or chinese (rows, tickers)."""
    services = {"titled": titled_panel, "status": status_panel, "chinese": chinese_panel}
    required = {"synthetic": (), "csv": ("path",), "parquet": ("path",)} | dict.fromkeys(services, ("rows", "tickers"))
    if source not in required:
        raise ValueError(f"unknown source: {source!r}")
    missing = [name for name in required[source] if options.get(name) is None]
    if missing:
        raise TypeError(f"source {source!r} needs {', '.join(missing)}")
    if source == "synthetic":
        return synthetic_panel(spark, Market(**options))
    if source == "csv":
        return panels.load_csv(spark, **options)
    if source == "parquet":
        return panels.densify(spark.read.parquet(options["path"]))
    return services[source](**options)
