"""Structured Streaming into the operation log, and event-time counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_log(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append all available rows of a stream to a Parquet log; the file sink commits each batch once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def day_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts by day and category; on a stream, days are closed ``late`` after their end."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", "1 day"), F.col("event_type").alias("category")).agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "category", "n")
