"""Streaming forms of three batch operators: coalescing, sessions, resumable intake."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coalesce_in_flight(events: DataFrame, keys: list[str], ts: str, lateness: str = "10 minutes") -> DataFrame:
    """Equal requests within the watermark are answered once."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def activity_sessions(events: DataFrame, key: str, ts: str, gap: str = "15 minutes", lateness: str = "1 hour") -> DataFrame:
    """Spans of activity, closed by ``gap`` of silence."""
    s = events.withWatermark(ts, lateness).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n"))
    return s.select(key, F.col("session_window.start").alias("began"), F.col("session_window.end").alias("until"), "n")


def intake(spark, path: str, schema: str, known: DataFrame, key: str, max_attempts: int = 2) -> DataFrame:
    """New files as a stream, without documents that are known or were tried too often."""
    done = known.where((F.col("status") == "parsed") | (F.col("attempts") >= max_attempts)).select(key)
    return spark.readStream.schema(schema).parquet(path).join(done, key, "left_anti")
