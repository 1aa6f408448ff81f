"""Continuous aggregates over events: event-time windows with a watermark, for readers that cannot wait for the next batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, late: str = "30 minutes", ts: str = "event_ts") -> DataFrame:
    """Events by hour and kind. Later ones than `late` behind the newest are dropped, as their window has been closed; the state holds open windows only."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events")).select(F.col("w.start").alias("event_hour"), "event_type", "n_events")


def first_seen(events: DataFrame, late: str = "30 minutes", ts: str = "event_ts", key: str = "event_id") -> DataFrame:
    """Each event once, however often it is sent within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
