"""Mixing sources to target weights.

Method: sizes are summed per source, every source's repetition rate is derived from its target, and a document
is emitted floor(rate) times, plus one Bernoulli copy whose chance is the fraction and whose draw is a hash of
doc_id, text and a seed: reruns and retried tasks agree.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a source of size
0 has target 0 and rate 0; rows that agree in doc_id and text share their draw, others, such as those with a null doc_id,
don't; mix() keeps all columns and their values, plan_mix() puts its own in place of those of the same names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import SPACE

#: Fixed values of the query's contract.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target. sizes: source, size.

    Weights go round the sources in code-point order. The capped share-out has a closed form: by rising ratio of
    cap to weight, sources before some place stop at their caps and the others get level * weight, where level is
    the largest of (budget - caps before) / (weights from here on).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (turn + 1).cast("int"))
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    capped = per_source.select("source", "source_size", weight.alias("weight"), (F.lit(most) * F.col("source_size")).alias("cap"))
    capped = capped.withColumn("ratio", F.col("cap") / F.col("weight"))
    budget = F.lit(share) * F.sum("source_size").over(whole)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = capped.withColumn("level", level)
    return levels.select("source", "source_size", F.least("cap", F.max("level").over(whole) * F.col("weight")).alias("target"))


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a hash."""
    parts = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(parts.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def plan_mix(docs: DataFrame, seed: str = "mix", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes the row)."""
    # both are functions of the text, which then needn't be exchanged for them
    sized = docs.drop("size", "source_size", "target", "copies").withColumns({"size": size_of(F.col("text")), "__draw": draw(F.col("doc_id"), F.col("text"), seed)})
    targets = source_targets(sized.select("source", "size"), weights, share, most)
    targets = targets.withColumnRenamed("source", "__of_source")
    joined = sized.join(targets, sized["source"].eqNullSafe(targets["__of_source"]), "left").drop("__of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + (F.col("__draw") < rate - F.floor(rate)).cast("long")
    return joined.withColumn("copies", F.coalesce(copies, F.lit(0)).cast("long")).drop("__draw")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of docs, each row as often as it is taken."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    planned = plan_mix(docs.select("doc_id", "text", "source", row.alias("__row")), **options)
    taken = planned.select("__row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
