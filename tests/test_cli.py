"""The synthetic panel, the demonstration and its reports."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from panelforge import cli
from panelforge.operators import evaluate
from panelforge.sources import panel as panels
from panelforge.sources import sinks
from panelforge.sources.synthetic import Market, synthetic_panel

SMALL = Market(stocks=12, dates=90)


def test_synthetic_panel(spark):
    panel, n_dates = synthetic_panel(spark, SMALL)
    rows = panel.toPandas()
    assert n_dates == 90 and len(rows) == 12 * 90 and (rows[["open", "high", "low", "close"]] > 0).all().all()
    assert panels.violations(panel).count() == 0
    moves = rows["close"] / rows["last_close"] - 1
    assert moves[rows["t"] > 0].abs().max() <= 0.1001
    again = synthetic_panel(spark, SMALL)[0].repartition(3).toPandas().sort_values(["n", "t"])["close"].tolist()
    assert again == rows.sort_values(["n", "t"])["close"].tolist()


def test_demo(spark, tmp_path):
    report = cli.demo(spark, str(tmp_path), SMALL)
    assert {r["strategy"] for r in report["results"]} == {"equal_weight", "factor_mean"}
    assert json.loads((tmp_path / "report/summary.json").read_text()) == report
    assert not [x for x in sinks.audit(report) if x[0] == "error"]
    curve = spark.read.parquet(str(tmp_path / "curve"))
    wide = sinks.equity_curves(curve, spark.read.parquet(str(tmp_path / "panel")))
    assert wide.columns == ["date", "equal_weight_equity", "equal_weight_return", "factor_mean_equity", "factor_mean_return"]
    assert wide.collect()[-1]["factor_mean_equity"] == pytest.approx(report["results"][1]["final_equity"])
    sinks.validation_report(evaluate.metrics(curve), evaluate.metrics(curve), str(tmp_path / "validation"), source="synthetic", costs_bps=7)
    assert {p.name for p in (tmp_path / "validation").iterdir()} == {"summary.json", "summary.md", "metadata.json", "cost_sensitivity.json", "cost_sensitivity.md", "submission.md"}
    manifest = sinks.export_dataset(spark.read.parquet(str(tmp_path / "panel")).where(F.col("t") < 3), str(tmp_path / "data"))
    assert manifest == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / "data").glob("part-*")}


def test_reports():
    assert sinks.markdown_table([{"a": "x|y", "b": float("inf"), "c": None}]).splitlines()[2] == "| x\\|y | inf | n/a |"
    assert sinks.strict({"a": [float("nan"), 1.0]}) == {"a": [None, 1.0]}
    assert ("error", "no results") in sinks.audit({})
