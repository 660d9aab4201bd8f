"""Event streams: counts in windows, distinct events, sessions and the quota latch. All work on streams and on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """ts as a timestamp with a watermark; watermarks don't take timestamps without a zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def counts(events: DataFrame, by: str, width: str, slide: str | None = None, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """by, start, n of tumbling windows, or of sliding ones; state older than the watermark goes."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return timed(events, ts, delay).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), "n")


def session_counts(events: DataFrame, by: str, gap: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    return timed(events, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct(events: DataFrame, key: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """One row of each key; on streams for repeats within the watermark."""
    rows = timed(events, ts, delay)
    return rows.dropDuplicatesWithinWatermark([key]) if events.isStreaming else rows.dropDuplicates([key])


def latch(events: DataFrame, account: str, window_key: Column, exhausted: Column) -> DataFrame:
    """account, window_key, exhausted: whether any event of the window says so. A new window starts afresh by its key."""
    return events.groupBy(account, window_key.alias("window_key")).agg(F.coalesce(F.max(exhausted), F.lit(False)).alias("exhausted"))
