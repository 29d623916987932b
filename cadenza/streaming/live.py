"""Streaming forms of series operators: levels per tumbling window, and quiet gaps.

These go beyond the batch operators: watermarks bound the state, late rows within the
watermark still count, and the batch and the streaming plan are the same expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def energy_windows(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Mean, peak and number of values per kind and window; works on batch and streaming frames."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = stamped.withWatermark("ts", late) if stamped.isStreaming else stamped
    found = marked.groupBy(F.window("ts", width), "event_type").agg(F.avg("value").alias("mean"), F.max("value").alias("peak"), F.count("*").alias("n"))
    return found.select(F.col("window.start").alias("start"), "event_type", "mean", "peak", "n")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Bursts of a user's events without a pause of ``gap``."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = stamped.withWatermark("ts", late) if stamped.isStreaming else stamped
    found = marked.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select("user_id", F.col("session_window.start").alias("start"), "n", "total")
