"""Connected components of a graph that may have any shape and any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import stored


#: Places that the larger neighbours of a node are dealt to.
SALTS = 16


def pulled(links: DataFrame) -> DataFrame:
    """The large-star step: of each node, all larger neighbours are linked to the least of it and its neighbours. links: u > v.

    A node may have very many larger neighbours: they are dealt to SALTS places, each with the least of the smaller ones.
    """
    larger = links.select(F.col("v").alias("node"), F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int").alias("salt"), "u", F.lit(None).cast("long").alias("low"))
    smaller = links.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(None).cast("long").alias("u"), "low")
    low = F.min("low").over(Window.partitionBy("node", "salt"))
    met = larger.union(smaller).withColumn("v", F.least("node", low))
    return met.where("u is not null").select("u", "v").distinct()


def gathered(links: DataFrame) -> DataFrame:
    """The small-star step: each node and its smaller neighbours, of which it has few here, are linked to the least of them."""
    least = links.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return least.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that has an edge. edges: a, b (long); order, loops and repeats don't matter.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until the links no longer change; they
    then join every node to the smallest of its component. Stars whose centre is their smallest node, as the callers
    give them, keep all groups of a step small. The links of a round are written and read again: a checkpoint's plan would keep
    the constraints of all rounds before it.
    """
    links = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    known = digest(links)
    while known[0]:
        links = stored(gathered(pulled(links)))
        seen = digest(links)
        if seen == known:
            break
        known = seen
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.union(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
