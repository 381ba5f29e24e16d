"""Streaming forms that Spark's own event-time operators express: windows, takes and aligned series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def telemetry_stream(frames: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """key, start, p, n: means of tumbling or sliding windows, whose state is dropped behind the watermark."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    found = frames.withWatermark("ts", delay).groupBy("key", w.alias("w")).agg(F.avg("p").alias("p"), F.count("*").alias("n"))
    return found.select("key", F.col("w.start").alias("start"), "p", "n")


def takes(frames: DataFrame, quiet: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """key, start, end, n: takes of a key's active frames, ended by ``quiet`` without one. Serves tables and streams."""
    found = frames.withWatermark("ts", delay).groupBy("key", F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("n"))
    return found.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def align_stream(raw: DataFrame, cleaned: DataFrame, delay: int, late: str = "10 minutes") -> DataFrame:
    """key, n, raw, x of two series of which the second lags by ``delay`` samples, joined as streams: both sides hold
    their rows until the watermark passes them."""
    left = raw.select("key", (F.col("n") + delay).alias("n"), F.col("x").alias("raw"), F.col("ts").alias("raw_ts")).withWatermark("raw_ts", late)
    right = cleaned.select(F.col("key").alias("k"), F.col("n").alias("m"), "x", "ts").withWatermark("ts", late)
    near = F.expr("key = k AND n = m AND ts >= raw_ts - INTERVAL 1 HOUR AND ts <= raw_ts + INTERVAL 1 HOUR")
    return left.join(right, near).select("key", "n", "raw", "x")
