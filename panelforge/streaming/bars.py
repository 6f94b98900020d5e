"""Bars, sessions and smoothed levels of event streams.

Every function takes a batch or a stream; a stream that has ended and a batch of the same rows agree. In append mode a stream gives a
window or a session once its watermark has passed the end: the largest time seen less `late`, as it stood after the trigger before.
Rows of windows that have been given are dropped; ids and levels of users that the watermark has passed are forgotten.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.plans.store import shared_folder


def event_bars(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """user_id, start, and a bar of value in tumbling (or, with slide, sliding) windows."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    at = F.struct("ts", "event_id")
    found = rows.groupBy(window.alias("w"), "user_id").agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select("user_id", F.col("w.start").alias("start"), "open", "high", "low", "close", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """user_id, start, end, n, total of runs of events with no gap between them."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    found = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event_id once; a stream forgets ids that its watermark has passed."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def smoothed(events: DataFrame, alpha: float = 0.1, late: str | None = None, idle_ms: int = 7 * 86_400_000) -> DataFrame:
    """user_id, event_id, ts, level of a stream: a running level per user, kept as state between batches. Events of a batch are taken in the order of time.

    late: the delay of a watermark; with it, late rows are dropped, and a level is forgotten idle_ms after its last event: the next one begins at 0.
    """

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        level, last = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        levels = []
        for value in rows["value"]:
            level = alpha * value + (1 - alpha) * level
            levels.append(level)
        last = max(last, int(rows["ts"].max().timestamp() * 1000))
        state.update((level, last))
        if late is not None:
            state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "ts": rows["ts"], "level": levels})

    kept = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    timed = kept if late is None else kept.withWatermark("ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, ts timestamp, level double", "level double, last long", "append", "NoTimeout" if late is None else "EventTimeTimeout")


def event_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The Parquet files of a folder, or one, as a stream, so many a trigger."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # a pattern that only this path fits: a stream takes a folder or a pattern, not a file
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(f"{path[:-1]}[{path[-1]}]")


def drained(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """What a stream appends until it has read all that there is. folder: where results and checkpoint are, by default a new shared one; a later call with the same folder goes on from there."""
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/streams-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
