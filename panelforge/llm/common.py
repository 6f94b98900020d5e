"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts of these operators define it.
SPACE = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only on a local master without one: on a cluster, its machines wouldn't see it."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all machines of the cluster share")
        known = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a small table by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *keys: str, **options: int) -> DataFrame:
    """Writes a table as compressed Parquet into the shared folder and reads it again; used where a table is large. options: the writer's.

    Like checkpoints, tables outlive the query, whose result is read from them later: those of an application are in one folder, which may go when it has ended.
    """
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys with at least this share of all rows are hot: at most 1 / HOT of them.
HOT = 0.001


def attach(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the other columns of groups, which has one row for each key (null too) and in n the number of its rows.

    The groups of hot keys are broadcast, at most 1 / HOT rows; the others are joined by a shuffle in which no key has
    more than HOT of all rows.
    """
    groups = cut(groups)
    total = groups.agg(F.sum("n")).first()[0] or 0
    renamed = groups.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in groups.columns if c not in (*keys, "n")], "n")
    hot, rest = (renamed.where((F.col("n") >= HOT * total) == which).drop("n") for which in (True, False))
    same = lambda: [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    own = [f"__{k}" for k in keys]
    few = F.broadcast(hot)
    return rows.join(few, same()).drop(*own).unionByName(rows.join(few.select(own), same(), "left_anti").join(rest, same()).drop(*own))


#: Rows that a task's Python holds and returns at a time.
ROWS = 256


def slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def words(text):
    """Column: the lower-cased (A-Z only) words of a text; null gives an empty array."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(f"([^{SPACE}]+)"), F.lit(1))
