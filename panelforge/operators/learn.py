"""Models over panel rows: the labelled set, walk-forward predictions, synthetic returns."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators import hashes, section


def labelled_set(rows: DataFrame, label: str = "target", valid: str = "target__m") -> DataFrame:
    """The rows that a model may learn from: valid today and on the label's date, with a finite label; never the last date's."""
    return rows.where(F.col(valid) & F.col(label).isNotNull() & ~F.isnan(label) & (F.abs(label) < float("inf")))


#: Models by name; each takes standardised features and the label.
MODELS = {
    "linear": lambda: LinearRegression(featuresCol="__x", labelCol="__y", predictionCol="prediction", regParam=1e-4),
    "trees": lambda: GBTRegressor(featuresCol="__x", labelCol="__y", predictionCol="prediction", maxIter=10, maxDepth=3, seed=42),
}


def walk_forward_predictions(rows: DataFrame, features: list[str], label: str, valid: str, splits: list[tuple[int, int, int, int]], model: str = "linear", store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """t, n, prediction: for each split (train from, train to, test from, test to) a model of its valid training rows, whose features are scaled by their own means and deviations.

    A split with fewer than max(32, 4 * features) training rows is left out. Where test ranges overlap, the later split's prediction stays, also where it has none.
    store: what the valid rows are written and read again by, so that the splits' passes don't each compute them anew.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model: {model!r}")
    fine = rows.where(F.col(valid)).select("t", "n", *features, F.col(label).alias("__y"))
    for f in features:
        fine = fine.where(F.col(f).isNotNull() & ~F.isnan(f))
    fine = store(fine) if store else fine
    kinds = [g(f).alias(f"{k}_{f}") for f in features for k, g in (("m", F.avg), ("s", F.stddev_pop))]
    found = None
    for start, end, first, last in splits:
        train = fine.where((F.col("t") >= start) & (F.col("t") < end) & F.col("__y").isNotNull())
        known = train.agg(F.count("*").alias("k"), *kinds).first()
        if known["k"] < max(32, 4 * len(features)):
            continue
        scaled = [((F.col(f) - known[f"m_{f}"]) / (known[f"s_{f}"] if known[f"s_{f}"] >= 1e-6 else 1.0)).alias(f) for f in features]
        pack = VectorAssembler(inputCols=features, outputCol="__x")
        fitted = MODELS[model]().fit(pack.transform(train.select(*scaled, "__y")))
        test = fine.where((F.col("t") >= first) & (F.col("t") < last)).select("t", "n", *scaled)
        made = fitted.transform(pack.transform(test)).select("t", "n", "prediction")
        found = made if found is None else found.where((F.col("t") < first) | (F.col("t") >= last)).union(made)
    return found if found is not None else rows.sparkSession.createDataFrame([], "t int, n int, prediction double")


def classified(rows: DataFrame, features: list[str], label: str, valid: str, split: tuple[int, int, int, int], above: float = 0.005, rounds: int = 3) -> DataFrame:
    """t, n, prediction: the probability, by boosted trees learned from the split's training dates, that the label is over a level; of the valid rows of its test dates."""
    start, end, first, last = split
    fine = rows.where(F.col(valid)).select("t", "n", *features, (F.col(label) > above).cast("double").alias("__y")).dropna(subset=features)
    packed = VectorAssembler(inputCols=features, outputCol="__x").transform(fine)
    model = GBTClassifier(featuresCol="__x", labelCol="__y", maxIter=rounds, maxDepth=3, seed=42).fit(packed.where((F.col("t") >= start) & (F.col("t") < end) & F.col("__y").isNotNull()))
    made = model.transform(packed.where((F.col("t") >= first) & (F.col("t") < last)))
    return made.select("t", "n", F.get(vector_to_array("probability"), F.lit(1)).alias("prediction"))


def simulated_targets(rows: DataFrame, paths: int = 2, steps: int = 60, limit: float = 0.2, seed: int = 0) -> DataFrame:
    """t, n, path, target, top, bottom: log returns at the end of, and at the highest and lowest point of, paths of a geometric Brownian motion over one date.

    rows: t, n, gap (where a path starts), mu, sigma. Draws are the MD5 of stock, date, path and step, by Box and Muller; a path is
    their prefix sum, and its target is clipped to limit. A batch of rows is drawn by array arithmetic: nothing is exchanged.
    """

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), max(1, hashes.TOGETHER // paths)):
                part = batch.slice(at, max(1, hashes.TOGETHER // paths))
                n, t, *start = (part[c].to_numpy(zero_copy_only=False) for c in ("n", "t", "gap", "mu", "sigma"))
                made = walked(n, t, *(x.astype(float) for x in start), paths, steps, seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(t, paths), pa.int32()), pa.array(np.repeat(n, paths), pa.int32()), pa.array(np.tile(np.arange(paths, dtype=np.int32), len(n))), *(pa.array(x, from_pandas=True) for x in made)], ["t", "n", "path", "at", "top", "bottom"])

    drawn = rows.select(F.col("t").cast("int").alias("t"), F.col("n").cast("int").alias("n"), *[F.col(c).cast("double").alias(c) for c in ("gap", "mu", "sigma")])
    found = drawn.mapInArrow(walks, "t int, n int, path int, at double, top double, bottom double")
    return found.select("t", "n", "path", F.greatest(F.least("at", F.lit(limit)), F.lit(-limit)).alias("target"), "top", "bottom")


def walked(n: np.ndarray, t: np.ndarray, gap: np.ndarray, mu: np.ndarray, sigma: np.ndarray, paths: int, steps: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ends of the paths of some rows, path by path of each, and their highest and lowest points."""
    texts = [f"{stock}|{date}|{path}|".encode() for stock, date in zip(n.tolist(), t.tolist(), strict=True) for path in range(paths)]
    sizes = np.array([len(text) for text in texts])
    at, drift, spread = (np.repeat(x, paths) for x in (gap, (mu - sigma * sigma / 2) / steps, sigma))
    top, bottom = np.full(len(at), -np.inf), np.full(len(at), np.inf)
    alike = [(own, np.frombuffer(b"".join(texts[i] for i in own), np.uint8).reshape(len(own), size)) for size in np.unique(sizes) for own in [np.flatnonzero(sizes == size)]]
    one, two = np.empty(len(at)), np.empty(len(at))
    for j in range(1, steps + 1):
        for own, keys in alike:
            one[own], two[own] = hashes.uniform_pairs(keys, f"{j}|{seed}".encode())
        at = at + (drift + spread * np.sqrt(-2 * np.log(1 - one)) * np.cos(2 * math.pi * two) / math.sqrt(steps))
        top, bottom = np.maximum(top, at), np.minimum(bottom, at)
    return at, top, bottom


def normal(*keys) -> Column:
    """A standard normal number that is a function of the keys only: by Box and Muller, from two hashes."""
    u = lambda salt: (F.pmod(F.xxhash64(*keys, F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))


def gbm_augment(returns: DataFrame, copies: int = 1, block: int = 20, seed: int = 0) -> DataFrame:
    """t, n, ret, mask of synthetic log returns, copies times as long as the panel: independent normal numbers with each stock's mean and deviation over its valid cells (two counted at least).

    returns: dense t, n, ret, mask. Draws are hashes of stock, row and seed, so that no partitioning changes them.
    """
    length = returns.agg(F.max("t")).first()[0]
    length = 0 if length is None else length + 1
    if not 0 < block <= length:
        raise ValueError(f"a block has between 1 and {length} rows, not {block}")
    fine = F.when(F.col("mask"), F.col("ret"))
    # with the mean of the sum over max(n, 2), the squares around it follow from sums
    sums = returns.groupBy("n").agg(F.coalesce(F.sum(fine), F.lit(0.0)).alias("s"), F.coalesce(F.sum(fine * fine), F.lit(0.0)).alias("ss"), F.count(fine).alias("k"))
    count, mu = F.greatest("k", F.lit(2)), F.col("s") / F.greatest("k", F.lit(2))
    variance = F.greatest((F.col("ss") - 2 * mu * F.col("s") + F.col("k") * mu * mu) / (count - 1), F.lit(1e-12))
    rows = sums.select("n", mu.alias("mu"), F.sqrt(variance).alias("sigma"), F.explode(F.sequence(F.lit(0), F.lit(copies * length - 1))).alias("t"))
    return rows.select("t", "n", (F.col("mu") + F.col("sigma") * normal("n", "t", F.lit(seed))).alias("ret"), F.lit(True).alias("mask"))


def features_and_target(panel: DataFrame, horizon: int = 1) -> DataFrame:
    """panel with its forward return, restricted to what can be learnt from."""
    return labelled_set(section.forward_return(panel, horizon))
