"""Written reports: found in a folder, read back as rows, bundled as score documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinemark.operators import scores

NAME = r"([^/]+?)\.([^./]+)\.report"


def report_parts(path: Column) -> dict[str, Column]:
    """challenger, region and metric of a path <folder>/<challenger>.<region>.report/<metric>/…; empty where it isn't one."""
    part = lambda i: F.regexp_extract(path, rf"{NAME}/([^/]+)(?:/|$)", i)
    return {"challenger": part(1), "region": part(2), "metric": part(3)}


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """challenger, region, metric, label, header, value of every table cell under a folder.

    All tables are read at once; lead days that a table doesn't have are absent. Reports are a few hundred numbers each.
    """
    wide = spark.read.json(f"{folder.rstrip('/')}/*.report/*").withColumn("_path", F.input_file_name())
    days = [c for c in wide.columns if c.startswith("Lead day ")]
    cells = F.explode(F.array(*[F.struct(F.lit(d).alias("header"), F.col(f"`{d}`").alias("value")) for d in days]))
    out = wide.where("label IS NOT NULL").select(*[c.alias(n) for n, c in report_parts(F.col("_path")).items()], "label", cells.alias("c"))
    return out.select("challenger", "region", "metric", "label", "c.header", "c.value").where("value IS NOT NULL")


def documents(cells: DataFrame) -> DataFrame:
    """challenger, region, metric and depths, the nested scores, of the rows of read_reports."""
    return scores.nested(scores.parse_rows(cells), ("challenger", "region", "metric"))


def available(cells: DataFrame) -> DataFrame:
    return cells.select("region", "challenger").distinct()
