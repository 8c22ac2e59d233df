"""Drift of particles in surface currents: seeds, trajectories and their deviation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinemark.model import EASTWARD, KM_PER_DEGREE, METRES_PER_DEGREE, NORTHWARD, PARTICLE_SEED, PARTICLES, REGIONAL_PARTICLES, SSH, STEP_HOURS, Cube


def ocean_points(surface: DataFrame, height: str = SSH) -> DataFrame:
    """lat_idx, lon_idx of the cells with a surface height on the first day of the first forecast."""
    first = surface.agg(F.min("first_day")).first()[0]  # partition pruning needs the literal
    return surface.where((F.col("first_day") == F.lit(first)) & (F.col("lead_day") == 0) & F.nanvl(F.col(height).cast("double"), F.lit(None)).isNotNull()).select("lat_idx", "lon_idx")


def particle_count(regional: int, whole: int, particles: int = PARTICLES, least: int = REGIONAL_PARTICLES) -> int:
    """Particles for a region by its share of ocean points; not fewer than least, unless it has fewer points."""
    if not regional or not whole:
        raise ValueError("There is no ocean point for a particle")
    return min(regional, max(least, round(particles * regional / whole)))


def seeds(points: DataFrame, n: int, seed: int = PARTICLE_SEED) -> DataFrame:
    """pid, lat_idx, lon_idx of n of the points, drawn without replacement from their row-major order.

    The order is never formed in one task: counts by row (as many as the axis has) give each row's start, a point's
    place in its row completes its rank, and the drawn ranks are joined.
    """
    spark = points.sparkSession
    rows = points.groupBy("lat_idx").count().orderBy("lat_idx").collect()
    total = sum(r["count"] for r in rows)
    if not total:
        raise ValueError("There is no ocean point for a particle")
    drawn = np.random.RandomState(seed).choice(total, min(n, total), replace=False)
    starts = np.cumsum([0, *(r["count"] for r in rows)])
    begin = spark.createDataFrame([(r["lat_idx"], int(s)) for r, s in zip(rows, starts, strict=False)], "lat_idx int, begin long")
    ranked = points.withColumn("place", F.row_number().over(W.partitionBy("lat_idx").orderBy("lon_idx")) - 1).join(F.broadcast(begin), "lat_idx")
    chosen = spark.createDataFrame([(i, int(k)) for i, k in enumerate(drawn)], "pid int, rank long")
    return ranked.withColumn("rank", F.col("begin") + F.col("place")).join(F.broadcast(chosen), "rank").select("pid", "lat_idx", "lon_idx")


class Day:
    """Surface currents of two days in a row on a grid, linear in time and bilinear in space."""

    def __init__(self, u: Sequence[np.ndarray], v: Sequence[np.ndarray], latitude: np.ndarray, longitude: np.ndarray):
        self.u, self.v, self.latitude, self.longitude = u, v, latitude, longitude

    def velocity(self, w: float, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Degrees a second in longitude and latitude at a share w of the day, and whether a place is off the grid."""
        out = (lat < self.latitude[0]) | (lat > self.latitude[-1]) | (lon < self.longitude[0]) | (lon > self.longitude[-1]) | np.isnan(lat)
        i = np.clip(np.searchsorted(self.latitude, lat, side="right") - 1, 0, len(self.latitude) - 2)
        j = np.clip(np.searchsorted(self.longitude, lon, side="right") - 1, 0, len(self.longitude) - 2)
        a = (lat - self.latitude[i]) / (self.latitude[i + 1] - self.latitude[i])
        b = (lon - self.longitude[j]) / (self.longitude[j + 1] - self.longitude[j])

        def at(x: Sequence[np.ndarray]) -> np.ndarray:
            flat = lambda f: (1 - a) * ((1 - b) * f[i, j] + b * f[i, j + 1]) + a * ((1 - b) * f[i + 1, j] + b * f[i + 1, j + 1])
            return flat(x[0]) if not w else (1 - w) * flat(x[0]) + w * flat(x[1])

        return at(self.u) / (METRES_PER_DEGREE * np.cos(np.radians(lat))), at(self.v) / METRES_PER_DEGREE, out

    def advance(self, lat: np.ndarray, lon: np.ndarray, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
        """Places a day later; a particle that leaves the grid is NaN from then on."""
        steps = 24 // STEP_HOURS
        for step in range(steps):
            lat, lon, lost = kernel(self, step / steps, 1 / steps, lat, lon, STEP_HOURS * 3600.0)
            lat[lost], lon[lost] = np.nan, np.nan
        return lat, lon


#: (day, share of it, step as a share, lat, lon, seconds) to (lat, lon, whether a particle is lost).
Kernel = Callable[[Day, float, float, np.ndarray, np.ndarray, float], tuple[np.ndarray, np.ndarray, np.ndarray]]


def fourth_order(field: Day, w: float, step: float, lat: np.ndarray, lon: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A fourth-order Runge-Kutta step."""
    x1, y1, o1 = field.velocity(w, lat, lon)
    x2, y2, o2 = field.velocity(w + step / 2, lat + y1 * dt / 2, lon + x1 * dt / 2)
    x3, y3, o3 = field.velocity(w + step / 2, lat + y2 * dt / 2, lon + x2 * dt / 2)
    x4, y4, o4 = field.velocity(w + step, lat + y3 * dt, lon + x3 * dt)
    return lat + (y1 + 2 * y2 + 2 * y3 + y4) * dt / 6, lon + (x1 + 2 * x2 + 2 * x3 + x4) * dt / 6, o1 | o2 | o3 | o4


class Field:
    """Daily surface currents (days, latitudes, longitudes); missing currents are 0."""

    def __init__(self, u: np.ndarray, v: np.ndarray, latitude: np.ndarray, longitude: np.ndarray):
        self.u, self.v, self.latitude, self.longitude = np.nan_to_num(u), np.nan_to_num(v), latitude, longitude

    def drift(self, lat: np.ndarray, lon: np.ndarray, days: int, kernel: Kernel = fourth_order) -> tuple[np.ndarray, np.ndarray]:
        """Positions (days + 1, particles)."""
        path = [(lat.astype(float), lon.astype(float))]
        for d in range(days):
            path.append(Day(self.u[d : d + 2], self.v[d : d + 2], self.latitude, self.longitude).advance(*path[-1], kernel))
        return np.array([p[0] for p in path]), np.array([p[1] for p in path])


def trajectories(currents: DataFrame, particles: DataFrame, latitude: Sequence[float], longitude: Sequence[float], lead_days: int, groups: Sequence[str] = ("first_day", "side"), kernel: Kernel = fourth_order) -> DataFrame:
    """groups, pid, day, lat, lon. currents: groups, lead_day, lat_idx, lon_idx, u, v; particles: pid, lat, lon.

    A first aggregate packs rows of the grid into arrays. A task gets forecasts one after the other, day by day, and drifts the
    particles from each day to the next; so it holds two days of currents in single precision, whatever the number of
    lead days or forecasts. Particles are at most PARTICLES and are shipped.
    """
    start = particles.orderBy("pid").toPandas()
    lats, lons = np.asarray(latitude, float), np.asarray(longitude, float)
    cells = F.sort_array(F.collect_list(F.struct("lon_idx", F.col("u").cast("float").alias("u"), F.col("v").cast("float").alias("v"))))
    packed = currents.groupBy(*groups, "lead_day", "lat_idx").agg(cells.alias("c")).select(*groups, "lead_day", "lat_idx", F.col("c.lon_idx").alias("j"), F.col("c.u").alias("u"), F.col("c.v").alias("v"))
    kinds = [packed.schema[g].dataType.simpleString() for g in groups]
    width, pid = len(groups), start.pid.to_numpy()

    def empty() -> list[np.ndarray]:
        return [np.zeros((len(lats), len(lons)), np.float32) for _ in range(2)]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, day, at, before, now = None, 0, None, empty(), empty()

        def told(d: int) -> pa.RecordBatch:
            names = [pa.array([k.as_py()] * len(pid), k.type) for k in key]
            return pa.RecordBatch.from_arrays([*names, pa.array(pid, pa.int32()), pa.array(np.full(len(pid), d, np.int32)), pa.array(at[0].copy()), pa.array(at[1].copy())], names=[*groups, "pid", "day", "lat", "lon"])

        def upto(d: int) -> Iterator[pa.RecordBatch]:
            """Ends the days before d; one without rows is still."""
            nonlocal day, at, before, now
            while day < d:
                if day:
                    at = Day((before[0], now[0]), (before[1], now[1]), lats, lons).advance(*at, kernel)
                yield told(day)
                before, now = now, before
                for f in now:
                    f[:] = 0
                day += 1

        for b in batches:
            own = [b.column(i) for i in range(width)]
            lead, row = b.column(width).to_numpy(), b.column(width + 1).to_numpy()
            js, us, vs = (b.column(width + 2 + i) for i in range(3))
            for r in range(len(b)):
                here = [c[r] for c in own]
                if here != key:
                    if key is not None:
                        yield from upto(lead_days)
                    key, day, at = here, 0, (start.lat.to_numpy(float), start.lon.to_numpy(float))
                    for f in (*before, *now):
                        f[:] = 0
                if lead[r] < lead_days:
                    yield from upto(int(lead[r]))
                    j = js[r].values.to_numpy()
                    for f, c in zip(now, (us, vs), strict=True):
                        f[row[r], j] = np.nan_to_num(c[r].values.to_numpy(zero_copy_only=False))
        if key is not None:
            yield from upto(lead_days)

    schema = ", ".join(f"{g} {k}" for g, k in zip(groups, kinds, strict=True)) + ", pid int, day int, lat double, lon double"
    out = packed.repartition(*groups).sortWithinPartitions(*groups, "lead_day").mapInArrow(over, schema)
    return out.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("lat", "lon")})


def distance(lat: Column, lon: Column, ref_lat: Column, ref_lon: Column) -> Column:
    """Kilometres on a local plane at the reference's latitude."""
    return F.sqrt(F.pow((lat - ref_lat) * KM_PER_DEGREE, 2) + F.pow((lon - ref_lon) * KM_PER_DEGREE * F.cos(F.radians(ref_lat)), 2))


def mean_deviation(challenger: DataFrame, reference: DataFrame) -> DataFrame:
    """day, deviation: the mean over particles of each forecast and day, then over forecasts. Lost particles drop out."""
    r = reference.select("first_day", "pid", "day", F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    each = challenger.join(r, ["first_day", "pid", "day"]).withColumn("d", distance(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon")))
    return each.groupBy("first_day", "day").agg(F.avg("d").alias("d")).groupBy("day").agg(F.avg("d").alias("deviation"))


def same_forecasts(challenger: DataFrame, reference: DataFrame) -> None:
    """An error unless both have forecasts of the same first days."""
    a, b = (x.select("first_day").distinct() for x in (challenger, reference))
    if odd := a.exceptAll(b).unionByName(b.exceptAll(a)).orderBy("first_day").first():
        raise ValueError(f"Only one of challenger and reference has a forecast of {odd[0]}")


def cube_deviation(challenger: Cube, reference: Cube, particles: int = PARTICLES, deviation: Callable[[DataFrame, DataFrame], DataFrame] = mean_deviation, kernel: Kernel = fourth_order) -> DataFrame:
    """lead_day (from 0), deviation in km, for the second to the last but one lead day, of two cubes on the same forecasts.

    deviation: day and deviation from the trajectories (first_day, pid, day, lat, lon) of both sides.
    """
    axes = challenger.axes
    same_forecasts(challenger.surface, reference.surface)
    at = seeds(ocean_points(challenger.surface), particles)
    spark = at.sparkSession
    coordinate = lambda values, index, name: F.broadcast(spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], f"{index} int, {name} double"))
    start = at.join(coordinate(axes.latitude, "lat_idx", "lat"), "lat_idx").join(coordinate(axes.longitude, "lon_idx", "lon"), "lon_idx").select("pid", "lat", "lon")

    def own(cube: Cube, side: str) -> DataFrame:
        top = cube.levels.where("depth_idx = 0").select("first_day", "lead_day", "lat_idx", "lon_idx", F.col(EASTWARD).alias("u"), F.col(NORTHWARD).alias("v"))
        return trajectories(top.withColumn("side", F.lit(side)), start, cube.axes.latitude, cube.axes.longitude, challenger.lead_days, kernel=kernel)

    out = deviation(own(challenger, "challenger"), own(reference, "reference"))
    return out.where(F.col("day").between(1, challenger.lead_days - 2)).select(F.col("day").alias("lead_day"), "deviation")
