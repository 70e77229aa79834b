"""Structured Streaming forms: the reference data model, fed continuously."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_cell_stats(cells: DataFrame, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Running statistics per cell; with ``event_time`` late data beyond ``delay`` is dropped and state is bounded by windows of a day."""
    aggs = [F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("vmin"), F.max("v").alias("vmax")]
    if event_time:
        return cells.withWatermark(event_time, delay).groupBy(F.window(event_time, "1 day"), "r", "c").agg(*aggs)
    return cells.groupBy("r", "c").agg(*aggs)


def tumbling(events: DataFrame, ts: str = "ts", value: str = "value", width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Count and mean of each window of time; the same plan runs on batch and stream."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w")).agg(F.count(value).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), "n", "mean")


def live_clusters(events: DataFrame, gap: str, ts: str = "ts", key: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Runs of events closer than ``gap``, as session windows."""
    w = F.session_window(ts, gap).alias("s")
    grouped = events.withWatermark(ts, delay).groupBy(*([key] if key else []), w)
    return grouped.agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")).drop("s")
