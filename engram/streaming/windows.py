"""Windowed aggregates; the same expressions serve batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str | None = None) -> DataFrame:
    """``ts`` as an instant, with a watermark when ``late`` is given."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late) if late else e


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    g = timed(events, late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str | None = None) -> DataFrame:
    g = timed(events, late).groupBy(F.window("ts", width, step).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    g = timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count("*").alias("n")).select("user_id", F.round(F.unix_micros("w.start") / 1e6, 3).alias("start"), "n")
