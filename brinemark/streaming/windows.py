"""Observations that arrive as a stream, matched with overlapping forecasts and scored as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinemark.functions.binning import lead_day


def matched_stream(points: DataFrame, first: str, step_days: int = 7, days: int = 10, time: str = "time", late: str = "2 days") -> DataFrame:
    """Points with first_day and lead_day of every forecast that holds them: windows of days that slide by step_days from first on.

    Works on batches and streams. Points later than the watermark are dropped by stateful steps that follow.
    """
    origin = f"{(_days_from_epoch(first) % step_days)} days"
    stamped = points.withWatermark(time, late) if points.isStreaming else points
    windows = stamped.withColumn("_w", F.window(F.col(time), f"{days} days", f"{step_days} days", origin))
    first_day = F.to_date(F.col("_w.start"))
    return windows.withColumn("first_day", first_day).where(first_day >= F.lit(first).cast("date")).withColumn("lead_day", lead_day(F.col(time), F.col("first_day")))


def _days_from_epoch(day: str) -> int:
    from datetime import date

    return (date.fromisoformat(day) - date(1970, 1, 1)).days


def counts_by_forecast(matched: DataFrame) -> DataFrame:
    """Points by window and lead day; on a stream a window's counts are final once the watermark has passed its end."""
    return matched.groupBy("_w", "lead_day").agg(F.count("*").alias("n")).select(F.to_date("_w.start").alias("first_day"), "lead_day", "n")
