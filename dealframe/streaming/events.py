"""Structured Streaming over the events table: windowed counts with late data."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by type in tumbling windows; rows later than the watermark are dropped by it."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", window), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def sliding_counts(events: DataFrame, key: str, size: str, slide: str, late: str) -> DataFrame:
    """(window, key, n, total): overlapping windows; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def session_counts(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """(session_window, key, n): a key's runs of events without a gap of that length."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))


def sessions_once(events: DataFrame, key: str, event: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n): sessions over events that each count once, whichever of their copies comes first within the watermark."""
    once = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([event])
    runs = once.groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return runs.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def finished(stream: DataFrame, at: str) -> DataFrame:
    """What a stream appends until it has read all that is there now, as a table below the shared folder ``at``."""
    spark, out = stream.sparkSession, f"{at}/dealframe/{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def running_state(events: DataFrame, key: str) -> DataFrame:
    """(key, n, total) after each batch: a count and a sum that live in the stream's state."""

    def step(k, frames, state):
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)
