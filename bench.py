"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from panelforge import queries
from panelforge.functions.factors import REGISTRY
from panelforge.plans import compiler, expr

HEADLINE = ("cs_rank", "ts_mean", "ts_rank", "ts_corr", "ewma", "factor_set_six")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    panel, n_dates = queries.weekly_panel(spark, sf_dir)
    panel = panel.repartition(int(cpus), "n").sortWithinPartitions("n", "t").cache()
    panel.count()
    values = {
        "cs_rank": {"value": queries.PRIMITIVES["cs_rank"]},
        "ts_mean": {"value": queries.PRIMITIVES["ts_mean"]},
        "ts_rank": {"value": expr.ts_rank(expr.field("close"), 20)},
        "ts_corr": {"value": queries.PRIMITIVES["ts_corr"]},
        "ewma": {"value": queries.PRIMITIVES["ewma"]},
        "factor_set_six": queries.joint_set(queries.factor_set(queries.SIX)),
        "factors_alpha": queries.factor_set([n for n in REGISTRY if n.startswith("alpha_")]),
    }
    times = {}
    for name, wanted in values.items():
        for _ in range(2):  # the first run plans and compiles
            start = time.perf_counter()
            compiler.evaluate(panel, wanted, n_dates).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    for name in ("panel_bars", "backtest", "rank_ic_daily", "market_breadth", "as_of_join", "event_sessions"):
        start = time.perf_counter()
        queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "seconds of the headline queries, second run on a cached panel for primitives and factors", "value": round(sum(times[n] for n in HEADLINE), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
