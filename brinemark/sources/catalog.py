"""Datasets by name: what each is made of, and how it is opened from a warehouse of Parquet tables.

Layout under the root: <kind>/<name>/<resolution>/levels and /surface, partitioned by first_day (series: by day) and
sorted by depth_idx, so partitions prune by forecast and row groups by depth; axes.json has the coordinates. A dataset that is stored
by variable has a folder for each part instead, <resolution>/parts/<part>/levels or /surface; they are merged as it is opened.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinemark.functions.binning import dates
from brinemark.functions.hashing import depth_grid_variant
from brinemark.model import FIRST_OBSERVATION, LEAD_DAYS, Axes, Cube, Resolution, Source
from brinemark.operators.axes import at_depths
from brinemark.operators.regrid import one_degree
from brinemark.sources import ingest, stage

ROOT = "BRINEMARK_DATA"


@dataclass(frozen=True)
class Dataset:
    """kind: challenger, reference, input. stamp: days from the first forecast day to the day in the stored name."""

    kind: str
    name: str
    lead_days: int = LEAD_DAYS
    start: str = "2024-01-03"
    end: str = "2024-12-25"
    step: int = 7
    stamp: int = 0
    one_degree: bool = True


# The datasets with their lead days and first days.
CHALLENGERS = {d.name: d for d in (Dataset("challenger", "glo12", stamp=1), Dataset("challenger", "glo36v1", 7, "2023-01-04", "2023-12-27", one_degree=False), Dataset("challenger", "glonet"), Dataset("challenger", "xihe"), Dataset("challenger", "wenhai"), Dataset("challenger", "langya", 7))}
REFERENCES = {"glorys_reanalysis": Dataset("reference", "glorys_reanalysis"), "glo12_analysis": Dataset("reference", "glo12_analysis")}
INPUTS = {"glo12_nowcasts": Dataset("input", "glo12_nowcasts", start="2023-01-03", end="2025-12-30"), "ifs_forcings": Dataset("input", "ifs_forcings", start="2023-01-03", end="2025-12-30")}
MONTHLY_START, MONTHLY_END = "1993-01-01", "2019-12-01"


def root_folder(root: str | None) -> str:
    found = root or os.environ.get(ROOT)
    if not found:
        raise ValueError(f"Name the folder of the data, or set {ROOT}")
    return found.rstrip("/")


def first_days(spark: SparkSession, dataset: Dataset) -> DataFrame:
    return dates(spark, dataset.start, dataset.end, dataset.step)


def stored_names(spark: SparkSession, dataset: Dataset) -> DataFrame:
    """first_day and the name of its stored forecast."""
    return first_days(spark, dataset).withColumn("stored", F.date_format(F.date_add("first_day", dataset.stamp), "yyyyMMdd"))


def months(spark: SparkSession, start: str = MONTHLY_START, end: str = MONTHLY_END) -> DataFrame:
    return spark.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}', INTERVAL 1 MONTH)) AS month")


def read_axes(spark: SparkSession, folder: str) -> Axes:
    """The coordinates, read by Spark so that any store will do."""
    row = spark.read.text(f"{folder}/axes.json", wholetext=True).first()
    data = json.loads(row[0])
    return Axes(tuple(data["latitude"]), tuple(data["longitude"]), tuple(data.get("depth", ())))


def _read(spark: SparkSession, path: str) -> DataFrame:
    return ingest.nulls_for_nans(ingest.standard_names(spark.read.parquet(path)))


def _stored(spark: SparkSession, folder: str, table: str, how: str, override: bool) -> DataFrame | None:
    """A table of a folder, or its parts merged; None if neither is there."""
    if stage.exists(spark, f"{folder}/{table}"):
        return _read(spark, f"{folder}/{table}")
    parts = [f"{folder}/parts/{x}/{table}" for x in stage.children(spark, f"{folder}/parts")]
    found = [_read(spark, x) for x in parts if stage.exists(spark, x)]
    return ingest.merged(found, how=how, override=override) if found else None


def open_cube(spark: SparkSession, dataset: Dataset, root: str | None = None, resolution: str = "native", preprocess: Callable[[DataFrame], DataFrame] | None = None) -> Cube:
    """A stored cube; at one degree it is interpolated unless it is stored so.

    Parts of a challenger keep the cells of all of them, those of a reference the cells of any. preprocess is applied to the
    rows of each table before anything else, whole forecasts at a time in whatever tasks Spark makes.
    """
    folder = f"{root_folder(root)}/{dataset.kind}/{dataset.name}/{resolution}"
    if resolution == Resolution.ONE_DEGREE.value and dataset.kind == "challenger" and not stage.exists(spark, folder):
        return one_degree(open_cube(spark, dataset, root, preprocess=preprocess))
    tables = []
    for name in ("levels", "surface"):
        df = _stored(spark, folder, name, "inner" if dataset.kind == "challenger" else "full", False)
        if df is not None:
            df = df.transform(preprocess) if preprocess else df
            df = ingest.require_columns(df, ["first_day", "lead_day", "lat_idx", "lon_idx"], f"{dataset.name} {name}").where(F.col("lead_day") < dataset.lead_days)
        tables.append(df)
    if not any(x is not None for x in tables):
        raise ValueError(f"No table of {dataset.name} in {folder}")
    return Cube(read_axes(spark, folder), *tables, dataset.lead_days, Source(dataset.kind, dataset.name, resolution))


def open_reference(spark: SparkSession, name: str, challenger: Cube, root: str | None = None) -> Cube:
    """The reference at the challenger's resolution, cut to its lead days; at a twelfth of a degree with the
    challenger's depths, each from the nearest stored level."""
    resolution = challenger.axes.resolution()
    cube = open_cube(spark, replace(REFERENCES[name], lead_days=challenger.lead_days), root, resolution.value)
    return at_depths(cube, challenger.axes.depth) if resolution is Resolution.TWELFTH_DEGREE and challenger.axes.depth else cube


def observations(spark: SparkSession, challenger: Cube, root: str | None = None) -> DataFrame:
    """Point observations of the days that the challenger's forecasts cover; partitions of other days aren't read."""
    low, high = challenger.surface.agg(F.min("first_day"), F.max("first_day")).first()
    points = spark.read.parquet(f"{root_folder(root)}/observations").where(F.col("day").between(F.lit(low), F.date_add(F.lit(high), challenger.lead_days - 1)))
    points = ingest.nulls_for_nans(ingest.standard_names(points))
    # a file and a place in it stay the same when a lost partition is read again
    return points.withColumn("point_id", F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")))


def are_observed(challenger: Cube) -> bool:
    """Whether observations exist for the challenger's first forecast."""
    first = challenger.surface.agg(F.min("first_day")).first()[0]
    return str(first)[:10] >= FIRST_OBSERVATION


def mean_topography(spark: SparkSession, resolution: Resolution, root: str | None = None) -> DataFrame:
    return _read(spark, f"{root_folder(root)}/mean_dynamic_topography/{resolution.value}").select("lat_idx", "lon_idx", "mdt")


def open_input(spark: SparkSession, name: str, root: str | None = None) -> DataFrame:
    """Weekly tables of an input under one another; of groups that share a variable the first one's counts."""
    folder = f"{root_folder(root)}/input/{name}"
    groups = stage.children(spark, f"{folder}/groups")
    if not groups:
        return _read(spark, folder)
    return ingest.merged([_read(spark, f"{folder}/groups/{g}") for g in groups], ("first_day", "time", "lead_day", "depth_idx", "lat_idx", "lon_idx"), override=True)


def monthly_series(spark: SparkSession, root: str | None = None, start: str = MONTHLY_START, end: str = MONTHLY_END) -> DataFrame:
    """The months of a reference at one degree, stored in a folder for each (month=yyyy-MM); other months aren't listed."""
    folder = f"{root_folder(root)}/reference/glorys_reanalysis_monthly/one_degree"
    return _read(spark, folder).where(F.col("month").between(start[:7], end[:7]))


def write_cube(cube: Cube, folder: str) -> None:
    """Store a cube in the layout that open_cube reads."""
    spark = (cube.levels if cube.levels is not None else cube.surface).sparkSession
    for name, df in (("levels", cube.levels), ("surface", cube.surface)):
        if df is not None:
            order = [c for c in ("lead_day", "depth_idx", "lat_idx", "lon_idx") if c in df.columns]
            df.repartition("first_day", "lead_day").sortWithinPartitions(*order).write.mode("overwrite").partitionBy("first_day").parquet(f"{folder}/{name}")
    axes = json.dumps({"latitude": cube.axes.latitude, "longitude": cube.axes.longitude, "depth": cube.axes.depth})
    spark.createDataFrame([(axes,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/axes.json")


def staged(cube: Cube, folder: str) -> Cube:
    """The cube, written once under its source's key in folder and read from there. A write that fails leaves nothing behind under the key."""
    spark = (cube.levels if cube.levels is not None else cube.surface).sparkSession
    if cube.source is None:
        raise ValueError("A cube without a source has no key to be staged under")
    depths = depth_grid_variant(cube.axes.depth) if cube.axes.depth else None
    at = f"{folder.rstrip('/')}/{replace(cube.source, variant=cube.source.variant or depths).key(cube.lead_days)}"
    with stage.build_guard(spark, at):
        if not stage.exists(spark, at):
            part = f"{at}.{uuid.uuid4().hex}.tmp"
            write_cube(cube, part)
            stage.publish(spark, part, at)
    read = lambda name, had: _read(spark, f"{at}/{name}") if had is not None else None
    return replace(cube, axes=read_axes(spark, at), levels=read("levels", cube.levels), surface=read("surface", cube.surface), attributes=cube.attributes | {"stage": at})
