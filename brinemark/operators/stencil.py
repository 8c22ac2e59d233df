"""Derived fields: geostrophic currents from surface height, mixed-layer depth from density."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinemark.functions.seawater import with_potential_density
from brinemark.model import CORIOLIS_MIN, EARTH_RADIUS, EQUATOR, GEO_EASTWARD, GEO_NORTHWARD, GRAVITY, MLD, MLD_CAP, MLD_THRESHOLD, OMEGA, SALINITY, SSH, TEMPERATURE, Cube
from brinemark.operators.axes import axis_frame, with_axis

CELL = ["first_day", "lead_day", "lat_idx", "lon_idx"]


def neighbours(df: DataFrame, value: str, n_lat: int, n_lon: int) -> DataFrame:
    """CELL with value here, east, west, north, south of every cell that has one of them.

    Each cell sends its value to its neighbours, so land cells without a row still get theirs, and one aggregate
    by cell, partial on the map side, replaces two window passes.
    """
    send = F.explode(F.array(*[F.struct(F.lit(to).alias("to"), F.lit(a).alias("a"), F.lit(o).alias("o")) for to, a, o in (("here", 0, 0), ("west", 0, 1), ("east", 0, -1), ("south", 1, 0), ("north", -1, 0))]))
    sent = df.where(F.col(value).isNotNull()).select(*CELL, F.col(value).alias("v"), send.alias("s"))
    sent = sent.select("first_day", "lead_day", (F.col("lat_idx") + F.col("s.a")).alias("lat_idx"), (F.col("lon_idx") + F.col("s.o")).alias("lon_idx"), "s.to", "v")
    sent = sent.where(F.col("lat_idx").between(0, n_lat - 1) & F.col("lon_idx").between(0, n_lon - 1))
    return sent.groupBy(*CELL).agg(*[F.max(F.when(F.col("to") == to, F.col("v"))).alias(to) for to in ("here", "east", "west", "north", "south")])


def gradient(low: Column, here: Column, high: Column, index: Column, n: int) -> Column:
    """Central difference by index, one-sided at the axis ends; null where a value it needs is missing."""
    return F.when(index == 0, high - here).when(index == n - 1, here - low).otherwise((high - low) / 2)


def geostrophic(df: DataFrame, latitude: Sequence[float], longitude: Sequence[float], height: str = SSH) -> DataFrame:
    """CELL and both geostrophic velocities off the equator."""
    spark = df.sparkSession
    steps = lambda axis: np.gradient(np.asarray(axis, float)).tolist()
    spacing = lambda axis, index, name: F.broadcast(spark.createDataFrame([(i, float(x)) for i, x in enumerate(steps(axis))], f"{index} int, {name} double"))
    out = neighbours(df, height, len(latitude), len(longitude))
    out = out.join(F.broadcast(axis_frame(spark, latitude, "lat_idx", "latitude").drop("latitude_key")), "lat_idx")
    out = out.join(spacing(latitude, "lat_idx", "step_lat"), "lat_idx").join(spacing(longitude, "lon_idx", "step_lon"), "lon_idx")
    phi = F.radians("latitude")
    f = 2 * OMEGA * F.sin(phi)
    f = F.when(F.abs(f) >= CORIOLIS_MIN, f)
    d_lon = gradient(F.col("west"), F.col("here"), F.col("east"), F.col("lon_idx"), len(longitude))
    d_lat = gradient(F.col("south"), F.col("here"), F.col("north"), F.col("lat_idx"), len(latitude))
    per_metre_x = d_lon / (F.col("step_lon") * (pi / 180) * EARTH_RADIUS * F.cos(phi))
    per_metre_y = d_lat / (F.col("step_lat") * (pi / 180) * EARTH_RADIUS)
    out = out.where((F.col("latitude") < -EQUATOR) | (F.col("latitude") > EQUATOR))
    return out.select(*CELL, (F.lit(-GRAVITY) / f * per_metre_y).alias(GEO_EASTWARD), (F.lit(GRAVITY) / f * per_metre_x).alias(GEO_NORTHWARD))


def geostrophic_cube(cube: Cube) -> Cube:
    return Cube(cube.axes, None, geostrophic(cube.surface, cube.axes.latitude, cube.axes.longitude), cube.lead_days, cube.source)


def mixed_layer(df: DataFrame, temperature: str = TEMPERATURE, density: str = "density", cap: float = MLD_CAP, threshold: float = MLD_THRESHOLD) -> DataFrame:
    """CELL and the mixed-layer depth from rows with depth_idx and depth.

    The first level whose density exceeds the surface's by the threshold, else the deepest with a temperature; null without a
    surface temperature. The surface comes down a cell's sorted levels by a window, whose exchange serves the aggregate too.
    """
    clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    levels = df.where(F.col("depth") <= cap).select(*CELL, "depth_idx", "depth", clean(temperature).alias("t"), clean(density).alias("rho"))
    down = W.partitionBy(*CELL).orderBy("depth_idx").rowsBetween(W.unboundedPreceding, 0)
    levels = levels.withColumn("rho0", F.first(F.when(F.col("depth_idx") == 0, F.col("rho"))).over(down))
    crossed = F.min(F.when(F.col("rho") - F.col("rho0") >= threshold, F.col("depth")))
    deepest = F.max(F.when(F.col("t").isNotNull(), F.col("depth")))
    surface = F.max(F.when(F.col("depth_idx") == 0, F.col("t")))
    return levels.groupBy(*CELL).agg(F.when(surface.isNotNull(), F.coalesce(crossed, deepest)).alias(MLD))


def mixed_layer_cube(cube: Cube, density=None) -> Cube:
    """The cube of mixed-layer depths. density: a function that adds a density column to rows with depth, else sea water's."""
    rows = with_axis(cube.levels, cube.axes.depth, "depth_idx", "depth").where(F.col("depth") <= MLD_CAP)
    rows = density(rows) if density else with_potential_density(rows, SALINITY, TEMPERATURE, "depth")
    return Cube(cube.axes, None, mixed_layer(rows), cube.lead_days, cube.source)
