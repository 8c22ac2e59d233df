"""Model against point observations: matching, sampling of the cube, deviation by depth bin and lead day."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinemark.functions.binning import depth_bin, lead_day, temperature_bin
from brinemark.model import BIN_ORDER, EASTWARD, NORTHWARD, POINT_ORDER, SALINITY, SPLINE_POINTS, SSH, SSH_SHIFT, TEMPERATURE, VELOCITY_DEPTH, Cube
from brinemark.operators.axes import end_weight, interval, levels_until
from brinemark.operators.rmsd import score_table

CLOSE = 1e-8, 1e-5  # absolute and relative distance of equal depths


def match_forecasts(points: DataFrame, forecasts: DataFrame, days: int, time: str = "time") -> DataFrame:
    """Each point with every forecast whose days hold it, as first_day and lead_day.

    forecasts: first_day, dates. The range condition becomes an equality: a point at a day can only belong to forecasts
    that start 0 to days - 1 days before, so these are listed and joined. A point in overlapping forecasts is repeated.
    """
    day = F.to_date(time)
    listed = points.withColumn("first_day", F.explode(F.sequence(F.date_sub(day, days - 1), day)))
    joined = listed.join(forecasts.select("first_day").distinct(), "first_day")
    return joined.withColumn("lead_day", lead_day(F.col(time), F.col("first_day"))).where(F.col("lead_day").between(0, days - 1))


def match_any_start(points: DataFrame, forecasts: DataFrame, days: int, time: str = "time") -> DataFrame:
    """As match_forecasts for starts at any time of day (first_day, timestamps): the start's date is joined, then checked."""
    day = F.to_date(time)
    listed = points.withColumn("_day", F.explode(F.sequence(F.date_sub(day, days), day)))
    starts = forecasts.select("first_day", F.to_date("first_day").alias("_day")).distinct()
    joined = listed.join(starts, "_day").drop("_day")
    end = F.col("first_day") + F.make_dt_interval(F.lit(days))
    joined = joined.where((F.col(time) >= F.col("first_day")) & (F.col(time) < end))
    return joined.withColumn("lead_day", lead_day(F.col(time), F.col("first_day")))


def known_forecasts(points: DataFrame, forecasts: DataFrame) -> DataFrame:
    """The points; the query fails if one belongs to a forecast (first_day) that isn't there."""
    there = forecasts.select("first_day").distinct().withColumn("_known", F.lit(True))
    unknown = F.raise_error(F.concat(F.lit("No forecast of "), F.col("first_day").cast("string"))).cast("boolean")
    return points.join(there, "first_day", "left").where(F.coalesce("_known", unknown)).drop("_known")


def binned(points: DataFrame, variable: str) -> DataFrame:
    """Points of a variable with depth_bin; those outside every bin go."""
    depth = F.col("depth")
    if variable == SSH:
        return points.withColumn("depth_bin", F.lit("surface"))
    return points.withColumn("depth_bin", temperature_bin(depth) if variable == TEMPERATURE else depth_bin(depth)).where("depth_bin IS NOT NULL")


def at_target_depth(points: DataFrame, target: float = VELOCITY_DEPTH, keys: Sequence[str] = ("time", "latitude", "longitude", "first_day", "lead_day"), value: str = "observation_value") -> DataFrame:
    """One observation at the target depth for each group with depths on both sides of it.

    Means by depth come first (partial sums on the map side); the nearest depths above and below are then a
    minimum and a maximum over a group's few depths, so no group is collected.
    """
    mean = points.where(F.col(value).isNotNull() & F.col("depth").isNotNull()).groupBy(*keys, "depth").agg(F.avg(value).alias("v"))
    low, high = F.max(F.when(F.col("depth") <= target, F.struct("depth", "v"))), F.min(F.when(F.col("depth") >= target, F.struct("depth", "v")))
    both = mean.groupBy(*keys).agg(low.alias("a"), high.alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    a, b = F.col("a"), F.col("b")
    near = F.abs(a.depth - b.depth) <= CLOSE[0] + CLOSE[1] * F.abs(b.depth)
    linear = a.v + F.try_divide(F.lit(target) - a.depth, b.depth - a.depth) * (b.v - a.v)
    return both.select(*keys, F.when(near, a.v).otherwise(linear).alias(value), F.lit(float(target)).alias("depth"), F.lit("15m").alias("depth_bin"))


def anomaly(heights: DataFrame, topography: DataFrame, height: str = SSH) -> DataFrame:
    """Surface height minus the mean topography (lat_idx, lon_idx, mdt) and the fixed shift."""
    return heights.join(topography, ["lat_idx", "lon_idx"]).withColumn(height, F.col(height) - F.col("mdt") - F.lit(SSH_SHIFT)).drop("mdt")


#: The corners of a box of the grid, by number: steps in latitude and longitude from its first cell.
BOX = (0, 0), (0, 1), (1, 0), (1, 1)


def _placed(points: DataFrame, latitude: Sequence[float], longitude: Sequence[float]) -> DataFrame:
    """The points inside the grid with the box of four cells around each (_i, _j: its first cell) and the place in it (_u, _v).

    Indices come before weights: in one expression their repeats make a method that is too long for the JVM to compile.
    """
    a, o = F.col("latitude"), F.col("longitude")
    boxed = points.withColumns({"_i": interval(a, latitude), "_j": interval(o, longitude)}).where("_i IS NOT NULL AND _j IS NOT NULL")
    return boxed.withColumns({"_u": end_weight(a, F.col("_i"), latitude), "_v": end_weight(o, F.col("_j"), longitude)})


def _blend(corners: Sequence[Column]) -> Column:
    """The bilinear value of a box's four corners at a point's place in it."""
    u, v = F.col("_u"), F.col("_v")
    a, b, c, d = ((u if i else 1 - u) * (v if j else 1 - v) * x for (i, j), x in zip(BOX, corners, strict=True))
    return a + b + c + d


def _met(boxes: DataFrame, cells: DataFrame, on: Sequence[str], value: str, *level: str) -> DataFrame:
    """boxes with the cells at their corners that have a value: _c, the corner's number, and _value."""
    corner = F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), (F.col("_i") + i).alias("lat_idx"), (F.col("_j") + j).alias("lon_idx")) for c, (i, j) in enumerate(BOX)]))
    spread = boxes.withColumn("_at", corner).select("*", "_at.*").drop("_at")
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    own = cells.select(*on, *level, "lat_idx", "lon_idx", v.alias("_value")).where("_value IS NOT NULL")
    return spread.join(own, [*on, *(x for x in level if x in boxes.columns), "lat_idx", "lon_idx"])


def _at_corner(c: int, name: str, where: str = "true") -> Column:
    return F.sum(F.when((F.col("_c") == c) & F.expr(where), F.col("_value"))).alias(name)


def _of_points(values: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """keys and value of each point that has one; keys that several points have identify none and go."""
    one = values.groupBy(*keys).agg(F.max(name).alias(name), F.count("*").alias("_n"))
    return one.where((F.col("_n") == 1) & F.col(name).isNotNull()).drop("_n")


def bilinear(points: DataFrame, cells: DataFrame, value: str, latitude: Sequence[float], longitude: Sequence[float], keys: Sequence[str], on: Sequence[str] = ("first_day", "lead_day"), name: str = "model_value") -> DataFrame:
    """keys and the bilinear value of cells at each point; null (no row) outside the grid or next to a missing corner.

    keys identify a point. Corners are joined to the distinct boxes that have points; a point is one row that meets
    its box. Only files of forecasts that have points are read.
    """
    placed, box = _placed(points.select(*dict.fromkeys([*keys, *on, "latitude", "longitude"])), latitude, longitude), [*on, "_i", "_j"]
    met = _met(placed.select(*box).distinct(), cells, on, value)
    boxes = met.groupBy(*box).agg(*[_at_corner(c, f"_v{c}") for c in range(4)], F.count("_value").alias("_n"))
    at = F.when(F.col("_n") == 4, _blend([F.col(f"_v{c}") for c in range(4)]))
    return _of_points(placed.join(boxes, box).select(*keys, at.alias(name)), keys, name)


def _between_levels(points: DataFrame, depth: Sequence[float]) -> DataFrame:
    """points (_q, a depth; _k, the levels above it) with the indices of the levels around (_a, _b) and the weight of the second (_w);
    beyond the ends both are the end."""
    values, q, a, b = F.array(*[F.lit(float(d)) for d in depth]), F.col("_q"), F.col("_a"), F.col("_b")
    points = points.withColumn("_b", F.least("_k", F.lit(len(depth) - 1)))
    points = points.withColumn("_a", F.when(F.get(values, b) == q, b).otherwise(F.greatest(F.col("_k") - 1, F.lit(0))))
    near = F.abs(F.get(values, a) - F.get(values, b)) <= CLOSE[0] + CLOSE[1] * F.abs(F.get(values, b))
    return points.withColumn("_w", F.when(near, F.lit(0.0)).otherwise(F.try_divide(q - F.get(values, a), F.get(values, b) - F.get(values, a))))


def sample_bracket(points: DataFrame, levels: DataFrame, value: str, latitude: Sequence[float], longitude: Sequence[float], depth: Sequence[float], keys: Sequence[str], on: Sequence[str] = ("first_day", "lead_day"), name: str = "model_value") -> DataFrame:
    """keys and the value of levels at each point: bilinear on the two levels around its depth, then linear.

    Beyond the first and last level the end's value holds. Null (no row) where any corner of either level is missing.
    Up to eight cells are joined to each distinct box and pair of levels that have points; a point is one row.
    """
    if len(depth) == 1:
        return bilinear(points, levels.where("depth_idx = 0"), value, latitude, longitude, keys, on, name)
    above = levels_until(F.col("depth"), depth, including=False)
    placed = _placed(points.select(*dict.fromkeys([*keys, *on, "latitude", "longitude"]), F.col("depth").alias("_q"), above.alias("_k")), latitude, longitude)
    placed = _between_levels(placed, depth)
    box = [*on, "_i", "_j", "_a", "_b"]
    met = _met(placed.select(*box).distinct().withColumn("depth_idx", F.explode(F.array_distinct(F.array("_a", "_b")))), levels, on, value, "depth_idx")
    ends = [_at_corner(c, f"{x}{c}", f"depth_idx = {x}") for x in ("_a", "_b") for c in range(4)]
    boxes = met.groupBy(*box).agg(*ends, F.count("_value").alias("_n"))
    at = F.when(F.col("_n") == F.when(F.col("_a") == F.col("_b"), 4).otherwise(8), _blend([(1 - F.col("_w")) * F.col(f"_a{c}") + F.col("_w") * F.col(f"_b{c}") for c in range(4)]))
    return _of_points(placed.join(boxes, box).select(*keys, at.alias(name)), keys, name)


def _bends(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives of the natural cubic splines through profiles (one a row; x ascending, no gaps).

    All profiles are solved together; the loops run over levels.
    """
    m, n = x.shape
    h = np.diff(x)
    slope = np.diff(y) / h
    diagonal, right = 2 * (h[:, :-1] + h[:, 1:]), 6 * np.diff(slope)
    for i in range(1, n - 2):  # elimination and substitution on the tridiagonal system
        f = h[:, i] / diagonal[:, i - 1]
        diagonal[:, i] -= f * h[:, i]
        right[:, i] -= f * right[:, i - 1]
    bend = np.zeros((m, n))
    for i in range(n - 3, -1, -1):
        bend[:, i + 1] = (right[:, i] - h[:, i + 1] * bend[:, i + 2]) / diagonal[:, i]
    return bend


def spline_pieces(x: np.ndarray, y: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Four factors of each profile's spline in its intervals k (a row of them a profile): of a ** 3, b ** 3, a and b,
    where a is the distance from the interval's end and b from its start."""
    bend, h = _bends(x, y), np.diff(x)
    at = lambda z, i: np.take_along_axis(z, i, 1)
    step, m0, m1 = at(h, k), at(bend, k), at(bend, k + 1)
    return np.stack([m0 / (6 * step), m1 / (6 * step), at(y, k) / step - m0 * step / 6, at(y, k + 1) / step - m1 * step / 6], 2)


def _intervals(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The interval of each row's ascending x that holds each of the row's q; an end's where q is outside."""
    return np.clip((x[:, None, :] <= q[:, :, None]).sum(2) - 1, 0, x.shape[1] - 2)


def natural_splines(x: np.ndarray, y: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The natural cubic splines through profiles (one a row; x ascending, no gaps), each at its q; NaN outside or with too few points."""
    m, n = x.shape
    if n < SPLINE_POINTS:
        return np.full(m, np.nan)
    k = _intervals(x, q[:, None])
    a, b = np.take_along_axis(x, k + 1, 1)[:, 0] - q, q - np.take_along_axis(x, k, 1)[:, 0]
    out = (spline_pieces(x, y, k)[:, 0] * np.stack([a**3, b**3, a, b], 1)).sum(1)
    return np.where((q >= x[:, 0]) & (q <= x[:, -1]), out, np.nan)


def natural_spline(x: np.ndarray, y: np.ndarray, q: float) -> float:
    """One profile's spline at q; levels without a value are left out."""
    keep = ~np.isnan(y)
    return float(natural_splines(x[keep][None].astype(float), y[keep][None].astype(float), np.array([q], float))[0])


def sample_spline(points: DataFrame, levels: DataFrame, value: str, latitude: Sequence[float], longitude: Sequence[float], depth: Sequence[float], keys: Sequence[str], on: Sequence[str] = ("first_day", "lead_day"), name: str = "model_value") -> DataFrame:
    """keys and the value of levels at each point: bilinear on every level, then a natural spline over depth.

    A level with a missing corner is left out, so a box's four corners have the same levels. Splines are linear in
    their values: those of the corners are solved once for each distinct box that has points, as one cubic a level of the
    axis, and a point is one row that meets the cubics of its box and level.
    """
    if len(depth) == 1:
        return bilinear(points, levels.where("depth_idx = 0"), value, latitude, longitude, keys, on, name)
    axis, box = sorted(float(d) for d in depth), [*on, "_i", "_j"]
    level = F.greatest(levels_until(F.col("depth"), axis) - 1, F.lit(0))
    placed = _placed(points.select(*dict.fromkeys([*keys, *on, "latitude", "longitude"]), F.col("depth").alias("_q"), level.alias("_k")), latitude, longitude)
    met = _met(placed.select(*box).distinct(), levels, on, value, "depth_idx")
    flat = met.groupBy(*box, "depth_idx").agg(*[_at_corner(c, f"_v{c}") for c in range(4)], F.count("_value").alias("_n")).where("_n = 4")
    flat = flat.withColumn("_d", F.get(F.array(*[F.lit(float(d)) for d in depth]), F.col("depth_idx"))).where("_d IS NOT NULL")
    profiles = flat.groupBy(*box).agg(F.sort_array(F.collect_list(F.struct("_d", *[f"_v{c}" for c in range(4)]))).alias("_p"))
    width = 2 + 4 * 4  # an interval's ends, four factors a corner

    @F.pandas_udf("array<double>")
    def pieces(xs: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        out, size, starts = np.full((len(xs), len(axis), width), np.nan), xs.map(len).to_numpy(), np.array(axis)
        for n in np.unique(size[size >= SPLINE_POINTS]):  # profiles of as many levels at once
            rows = np.flatnonzero(size == n)
            x, *ys = (np.stack(s.iloc[rows].to_list()).astype(float) for s in (xs, a, b, c, d))
            k = _intervals(x, np.broadcast_to(starts, (len(rows), len(starts))))
            ends = [np.take_along_axis(x, i, 1)[:, :, None] for i in (k, k + 1)]
            solved = np.concatenate([*ends, *(spline_pieces(x, y, k) for y in ys)], 2)
            solved[(starts < x[:, :1]) | (starts > x[:, -1:])] = np.nan
            out[rows] = solved
        return pd.Series(list(out.reshape(len(xs), -1)))

    cubics = profiles.select(*box, pieces("_p._d", *[f"_p._v{c}" for c in range(4)]).alias("_all"))
    cubics = cubics.select(*box, "_all", F.explode(F.sequence(F.lit(0), F.lit(len(axis) - 1))).alias("_k"))
    cubics = cubics.select(*box, "_k", *[F.element_at("_all", F.col("_k") * width + i + 1).alias(f"_s{i}") for i in range(width)])
    start, end, *factors = (F.col(f"_s{i}") for i in range(width))
    a, b, q = end - F.col("_q"), F.col("_q") - start, F.col("_q")
    corners = [(f * a * a * a + g * b * b * b) + (h * a + i * b) for f, g, h, i in zip(*[iter(factors)] * 4, strict=True)]
    at = F.when((q >= start) & (q <= end), F.nanvl(_blend(corners), F.lit(None)))
    return _of_points(placed.join(cubics, [*box, "_k"]).select(*keys, at.alias(name)), keys, name)


def point_deviations(pairs: DataFrame) -> DataFrame:
    """depth_bin, lead_day, rmsd, n from model_value and observation_value; squares are pooled over all forecasts."""
    return (
        pairs.where("model_value IS NOT NULL AND observation_value IS NOT NULL")
        .groupBy("depth_bin", "lead_day")
        .agg(F.sqrt(F.avg(F.pow(F.col("model_value") - F.col("observation_value"), 2))).alias("rmsd"), F.count("*").alias("n"))
    )


def variable_deviations(cube: Cube, matched: DataFrame, variable: str, topography: DataFrame | None = None) -> DataFrame:
    """variable, depth_bin, lead_day, rmsd, n of one variable. matched: points with point_id, time, latitude, longitude,
    depth, first_day, lead_day and the variable's observations in a column of its name."""
    axes = cube.axes
    points = matched.select("point_id", "time", "latitude", "longitude", "depth", "first_day", "lead_day", F.nanvl(F.col(variable).cast("double"), F.lit(None)).alias("observation_value"))
    points = points.where("observation_value IS NOT NULL")
    keys = ["point_id", "first_day", "lead_day"]
    if variable in (EASTWARD, NORTHWARD):
        points = at_target_depth(points).withColumn("point_id", F.xxhash64("time", "latitude", "longitude"))
        keys = ["time", "latitude", "longitude", "first_day", "lead_day"]
    else:
        points = binned(points, variable)
    if variable == SSH:
        cells = anomaly(cube.surface, topography) if topography is not None else cube.surface
        model = bilinear(points, cells, variable, axes.latitude, axes.longitude, keys)
    elif variable == SALINITY:
        model = sample_spline(points, cube.levels, variable, axes.latitude, axes.longitude, axes.depth, keys)
    else:
        model = sample_bracket(points, cube.levels, variable, axes.latitude, axes.longitude, axes.depth, keys)
    return point_deviations(points.join(model, keys)).withColumn("variable", F.lit(variable))


def point_table(deviations: DataFrame, lead_days: int) -> DataFrame:
    """label and a column for each lead day, by variable and then bin."""
    return score_table(deviations.withColumnRenamed("depth_bin", "depth"), POINT_ORDER, lead_days, points=True, depths=BIN_ORDER)
