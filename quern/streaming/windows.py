"""Event-time windows over streams: the same functions serve batch frames, which is how they are tested."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stamped(events: DataFrame, late: str) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if rows.isStreaming else rows


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and their value by window and type."""
    rows = _stamped(events, late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "24 hours", step: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Events in windows that overlap."""
    rows = _stamped(events, late).groupBy(F.window("ts", size, step).alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Runs of a user's events without a pause of `gap`."""
    rows = _stamped(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return rows.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def first_in_slot(events: DataFrame, minutes: int = 10, late: str = "1 hour") -> DataFrame:
    """One event for each type and time slot, as schedulers take them."""
    slot = F.floor(F.unix_seconds("ts") / (60 * minutes)).cast("long")
    rows = _stamped(events, late).select("ts", "event_type").withColumn("slot", slot)
    kept = rows.dropDuplicatesWithinWatermark(["event_type", "slot"]) if rows.isStreaming else rows.dropDuplicates(["event_type", "slot"])
    return kept.select("event_type", "slot")
