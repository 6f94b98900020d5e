"""python -m panelforge.cli demo --out FOLDER: synthetic panel, factors, books, backtest, report."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.factors import REGISTRY
from panelforge.operators import books, evaluate, section
from panelforge.plans import compiler, expr
from panelforge.sources import panel as panels
from panelforge.sources import sinks
from panelforge.sources.synthetic import Market, synthetic_panel

FACTORS = ("best_001", "stock_001", "add_015", "old_042", "alpha_101")


def mean_score(panel: DataFrame, n_dates: int, names=FACTORS) -> DataFrame:
    """t, n, score: the mean of standardised factors."""
    values = {name: expr.cs_zscore(compiler.finite(REGISTRY[name])) for name in names}
    wide = compiler.evaluate(panel, values, n_dates)
    total = sum((F.coalesce(F.col(name), F.lit(0.0)) for name in names), F.lit(0.0))
    known = sum((F.col(name).isNotNull().cast("int") for name in names), F.lit(0))
    return wide.select("t", "n", F.when(known > 0, total / known).alias("score"))


def demo(spark: SparkSession, out: str, market: Market, costs_bps: float = 7.0) -> dict:
    made, n_dates = synthetic_panel(spark, market)
    panel = sinks.write_stage(panels.with_returns(section.limit_move_mask(made)), f"{out}/panel")
    scored = sinks.write_stage(panel.join(mean_score(panel, n_dates), ["t", "n"]).select("t", "n", "score", "ret", (F.col("mask") & F.col("free") & F.col("score").isNotNull()).alias("valid")), f"{out}/scores")
    every = books.equal_weight(scored).select(F.lit("equal_weight").alias("strategy"), "t", "n", "weight")
    best = books.top_quantile(scored, "score").select(F.lit("factor_mean").alias("strategy"), "t", "n", "weight")
    weights = sinks.write_stage(every.union(best), f"{out}/weights")
    curve = sinks.write_stage(books.backtest(weights, scored, costs_bps), f"{out}/curve")
    return sinks.summary(evaluate.metrics(curve), f"{out}/report", source="synthetic", costs_bps=costs_bps, stocks=market.stocks, dates=market.dates)


def main(argv=None) -> None:
    parser = argparse.ArgumentParser(prog="panelforge")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("demo", help="the whole pipeline on a synthetic panel")
    run.add_argument("--out", required=True)
    run.add_argument("--stocks", type=int, default=Market.stocks)
    run.add_argument("--dates", type=int, default=Market.dates)
    run.add_argument("--costs-bps", type=float, default=7.0)
    check = commands.add_parser("audit", help="what is wrong with a report")
    check.add_argument("report")
    options = parser.parse_args(argv)
    if options.command == "audit":
        with open(options.report) as file:
            found = sinks.audit(json.load(file))
        print("\n".join(f"{severity}: {what}" for severity, what in found) or "nothing found")
        return
    spark = SparkSession.builder.appName("panelforge").getOrCreate()
    print(json.dumps(demo(spark, options.out, Market(stocks=options.stocks, dates=options.dates), options.costs_bps), indent=2))


if __name__ == "__main__":
    main()
