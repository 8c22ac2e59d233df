"""Interpolation of a cube to cell centres at whole degrees and a half."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinemark.model import Axes, Cube, Source


def degree_axis(axis: Sequence[float]) -> list[float]:
    """The centres, a degree apart, that lie within the axis."""
    start, end = ceil(min(axis) - 0.5) + 0.5, floor(max(axis) + 0.5) - 0.5
    return [start + i for i in range(int(end - start) + 1)] if end >= start else []


def weights(axis: Sequence[float], targets: Sequence[float]) -> list[tuple[int, int, float]]:
    """(source index, target index, weight): two rows for each target inside the axis."""
    out = []
    for t, q in enumerate(targets):
        if axis[0] <= q <= axis[-1]:
            i = max((k for k in range(len(axis) - 1) if axis[k] <= q), default=0)
            w = (q - axis[i]) / (axis[i + 1] - axis[i])
            out += [(i, t, 1 - w), (i + 1, t, w)]
    return out


def interpolate(df: DataFrame, variables: Sequence[str], latitude: Sequence[float], longitude: Sequence[float], keys: Sequence[str], targets: tuple[Sequence[float], Sequence[float]] | None = None) -> DataFrame:
    """keys, lat_idx, lon_idx and variables on the new axes; a value next to a missing corner is missing.

    Weights are two rows a target, of the axes' length, and are broadcast; the cells are shuffled once, by target,
    after partial sums, which take most of the volume where the source is finer than a degree.
    """
    spark = df.sparkSession
    to = targets or (degree_axis(latitude), degree_axis(longitude))
    side = lambda axis, t, name: F.broadcast(spark.createDataFrame(weights(axis, t), f"{name}_idx int, to_{name} int, w_{name} double"))
    met = df.join(side(latitude, to[0], "lat"), "lat_idx").join(side(longitude, to[1], "lon"), "lon_idx")
    v = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    sums = [x for c in variables for x in (F.sum(F.col("w_lat") * F.col("w_lon") * v(c)).alias(c), F.count(v(c)).alias(f"_n_{c}"))]
    out = met.groupBy(*keys, F.col("to_lat").alias("lat_idx"), F.col("to_lon").alias("lon_idx")).agg(*sums)
    return out.select(*keys, "lat_idx", "lon_idx", *[F.when(F.col(f"_n_{c}") == 4, F.col(c)).alias(c) for c in variables])


def one_degree(cube: Cube) -> Cube:
    axes = Axes(tuple(degree_axis(cube.axes.latitude)), tuple(degree_axis(cube.axes.longitude)), cube.axes.depth)
    own = lambda df, keys: None if df is None else interpolate(df, [c for c in df.columns if c not in (*keys, "lat_idx", "lon_idx")], cube.axes.latitude, cube.axes.longitude, keys)
    source = cube.source and Source(cube.source.kind, cube.source.name, "one_degree", cube.source.variant)
    return Cube(axes, own(cube.levels, ["first_day", "lead_day", "depth_idx"]), own(cube.surface, ["first_day", "lead_day"]), cube.lead_days, source)
