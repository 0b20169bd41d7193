"""Streams over the same operators: JSON-lines ingestion with dedup, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def distinct_stream(stream: DataFrame, key: list[str], time_col: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of each key to arrive. With an event time, state is dropped after the delay; without, it grows."""
    if time_col is None:
        return stream.dropDuplicates(key)
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(key)


def window_counts(events: DataFrame, time_col: str = "ts", key: str = "event_type", width: str = "1 hour", delay: str = "10 minutes", value: str = "value") -> DataFrame:
    """Counts and sums in tumbling windows, for batches and streams alike."""
    source = events.withWatermark(time_col, delay) if events.isStreaming else events
    out = source.groupBy(F.window(time_col, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), key, "n", "total")


def session_counts(events: DataFrame, time_col: str = "ts", user: str = "user_id", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    source = events.withWatermark(time_col, delay) if events.isStreaming else events
    out = source.groupBy(F.session_window(time_col, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return out.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
