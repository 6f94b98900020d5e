"""Where results go: tables by Spark, small reports by the driver."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """Writes a stage's table and reads it again: later stages don't recompute it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def strict(value):
    """A value that strict JSON has: what isn't finite becomes null."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {str(k): strict(v) for k, v in value.items()}
    return [strict(v) for v in value] if isinstance(value, list | tuple) else value


def markdown_table(rows: list[dict]) -> str:
    """A table of rows with the same keys: numbers with four decimals, n/a for what isn't known, bars escaped."""

    def cell(x) -> str:
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "n/a"
        if isinstance(x, float):
            return "inf" if math.isinf(x) else f"{x:.4f}"
        return str(x).replace("|", "\\|")

    names = list(rows[0]) if rows else []
    lines = [names, ["---"] * len(names), *([cell(r[c]) for c in names] for r in rows)]
    return "".join("| " + " | ".join(line) + " |\n" for line in lines)


def summary(metrics: DataFrame, folder: str, **metadata) -> dict:
    """summary.json and summary.md of a table of metrics: a row per strategy."""
    rows = [r.asDict() for r in metrics.orderBy("strategy").collect()]
    report = strict({"metadata": metadata, "results": rows})
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, "summary.json").write_text(json.dumps(report, indent=2, allow_nan=False))
    Path(folder, "summary.md").write_text(markdown_table(rows))
    return report


def equity_curves(curve: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """t (with dates (t, date): date) and two columns for each strategy: the return of the date and what one unit has become. Names of strategies are a dimension: few."""
    names = sorted(r[0] for r in curve.select("strategy").distinct().collect())
    grown = F.exp(F.sum(F.log1p(F.greatest("net", F.lit(-0.999999999)))).over(Window.partitionBy("strategy").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    wide = curve.withColumn("__equity", grown).groupBy("t").pivot("strategy", names).agg(F.first("__equity").alias("equity"), F.first("net").alias("return"))
    wide = wide.orderBy("t")
    return wide if dates is None else dates.select("t", "date").distinct().join(wide, "t").drop("t").orderBy("date")


def export_dataset(panel: DataFrame, folder: str) -> dict[str, str]:
    """Compressed CSV of a panel by Spark's writer, numbers with nine digits. The manifest, also written beside the parts, has the digest of every file: files are read as binary rows, each by one task, wherever the folder is."""
    number = lambda c: F.format_string("%.9g", F.col(c)).alias(c)
    columns = ["date", F.col("stock").alias("asset_id"), *map(number, ("open", "high", "low", "close", "volume", "vwap", "amount")), F.col("mask").alias("tradable")]
    panel.select(*columns).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(folder)
    spark = panel.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    digests = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))
    manifest = {r["file"]: r["sha256"] for r in digests.orderBy("file").collect()}
    spark.createDataFrame(list(manifest.items()) or [("", "")], "file string, sha256 string").coalesce(1).write.mode("overwrite").json(folder.rstrip("/") + "_manifest")
    return manifest


def cost_table(grid: DataFrame) -> list[dict]:
    """Rows of a cost sensitivity: the figures of each strategy at each level, for a table or a report."""
    return [r.asDict() for r in grid.orderBy("strategy").collect()]


def validation_report(metrics: DataFrame, grid: DataFrame, folder: str, **metadata) -> dict:
    """summary.json, summary.md, metadata.json, cost_sensitivity.json, cost_sensitivity.md and submission.md of a validation run."""
    report = summary(metrics, folder, **metadata)
    costs = strict(cost_table(grid))
    Path(folder, "metadata.json").write_text(json.dumps(strict(metadata), indent=2, sort_keys=True, allow_nan=False))
    Path(folder, "cost_sensitivity.json").write_text(json.dumps(costs, indent=2, allow_nan=False))
    Path(folder, "cost_sensitivity.md").write_text(markdown_table(costs))
    head = "".join(f"- {name}: {value}\n" for name, value in sorted(metadata.items()))
    Path(folder, "submission.md").write_text(f"# Validation\n\n{head}\n{markdown_table(report['results'])}\n## Costs\n\n{markdown_table(costs)}")
    return report


#: Checks of a report: severity, what is wrong, and when.
RULES = (
    ("error", "no results", lambda m, rows: not rows),
    ("error", "a drawdown is outside 0 to 1", lambda m, rows: any(not 0 <= (r.get("max_drawdown") or 0) <= 1 for r in rows)),
    ("error", "a strategy is listed twice", lambda m, rows: len({r["strategy"] for r in rows}) < len(rows)),
    ("warning", "source is not named", lambda m, rows: not m.get("source")),
    ("warning", "costs are not given", lambda m, rows: m.get("costs_bps") is None),
    ("warning", "fewer than 60 periods", lambda m, rows: any((r.get("n_periods") or 0) < 60 for r in rows)),
    ("warning", "an unknown Sharpe ratio", lambda m, rows: any(r.get("sharpe") is None for r in rows)),
)


def audit(report: dict) -> list[tuple[str, str]]:
    metadata, rows = report.get("metadata", {}), report.get("results", [])
    return [(severity, what) for severity, what, wrong in RULES if wrong(metadata, rows)]
