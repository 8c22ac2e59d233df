"""Depth bins, lead days and date sequences as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinemark.model import DEPTH_BINS


def depth_bin(depth: Column) -> Column:
    """The half-open bin of a depth; null outside all. Where bins overlap the last one holds."""
    out = F.lit(None).cast("string")
    for name, (low, high) in DEPTH_BINS.items():
        out = F.when((depth >= low) & (depth < high), F.lit(name)).otherwise(out)
    return out


def temperature_bin(depth: Column) -> Column:
    """As depth_bin, with [-1, 1) as the surface."""
    return F.when((depth >= -1) & (depth < 1), F.lit("surface")).otherwise(depth_bin(depth))


def lead_day(time: Column, first_day: Column) -> Column:
    """Whole days from first_day to time, cut towards zero."""
    micros = F.unix_micros(time.cast("timestamp")) - F.unix_micros(first_day.cast("timestamp"))
    return (micros / F.lit(86_400_000_000.0)).cast("int")


def dates(spark: SparkSession, start: str, end: str, days: int, name: str = "first_day") -> DataFrame:
    """The dates from start to end, both included, every so many days."""
    return spark.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}', INTERVAL {int(days)} DAYS)) AS {name}")
