"""Queries by name, and the DuckDB SQL that gives the same rows.

Each query applies one operator of the library to the tables of sources.adapters. Doubles are rounded to six decimals,
as sums in another order differ in their last digits; means of prices, which can end in a 5 at the seventh, are cut
at an uneven place instead.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinemark.functions import binning, labels, seawater
from brinemark.functions.hashing import depth_grid_hash_column
from brinemark.functions.seawater import with_potential_density
from brinemark.model import DISPLAY, GEO_EASTWARD, GEO_NORTHWARD, MLD, PARTICLE_SEED, SALINITY, SCORE_DEPTHS, SSH, TEMPERATURE
from brinemark.operators import class4, lagrangian, regions, rmsd, scores, stencil
from brinemark.operators.axes import nearest_levels, select_levels, with_axis
from brinemark.operators.regrid import degree_axis, interpolate, weights
from brinemark.sources import adapters as A
from brinemark.sources import ingest
from brinemark.streaming.windows import matched_stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = A.with_views(sql, *views) if views else sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


_PLACE = 0.3183099


def settled(c: str) -> F.Column:
    """Six decimals of a value, cut where no mean of decimals lies."""
    return F.floor(F.col(c) * 1_000_000 + _PLACE) / 1_000_000


def settled_sql(x: str) -> str:
    return f"floor({x} * 1000000 + {_PLACE}) / 1000000"


def sides(df: DataFrame, names: tuple[str, ...], keys: list[str], variable: str) -> tuple[DataFrame, DataFrame]:
    """The challenger's and the reference's rows of a two-sided adapter table."""
    return tuple(df.select(*keys, F.col(n).alias(variable)) for n in names)


def keyed(df: DataFrame) -> DataFrame:
    df = with_axis(df, A.LATITUDE, "lat_idx", "latitude")
    return with_axis(df, A.LONGITUDE, "lon_idx", "longitude")


def _grid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = keyed(select_levels(A.grid_cells(spark, sf_dir), nearest_levels(A.DEPTH, SCORE_DEPTHS)))
    return rmsd.deviations(*sides(g, ("c_value", "r_value"), rmsd.KEYS, TEMPERATURE), [TEMPERATURE])


_GRID = """each AS (SELECT first_day, lead_day, label AS depth, sqrt(avg(power(c_value - r_value, 2))) AS x FROM grid_cells JOIN axis_depth USING (depth_idx) GROUP BY ALL),
mean AS (SELECT lead_day, depth, avg(x) AS rmsd FROM each GROUP BY ALL)"""


@query(f"WITH {_GRID} SELECT '{TEMPERATURE}' AS variable, depth, lead_day, round(rmsd, 6) AS rmsd FROM mean", "grid_cells", "axis_depth")
def grid_rmsd_by_lead_depth(spark, sf_dir):
    return rounded(_grid_scores(spark, sf_dir), "rmsd")


def _pivot(value: str, days=range(10), start: int = 1) -> str:
    return ", ".join(f'round(max(CASE WHEN lead_day = {i} THEN {value} END), 6) AS "Lead day {i + start}"' for i in days)


@query(f"WITH {_GRID} SELECT 'Temperature (°C) [{TEMPERATURE}]{{' || depth || '}}' AS label, {_pivot('rmsd')} FROM mean GROUP BY depth", "grid_cells", "axis_depth")
def grid_rmsd_pivot(spark, sf_dir):
    out = rmsd.score_table(_grid_scores(spark, sf_dir), [TEMPERATURE], A.DAYS)
    return rounded(out, *labels.lead_day_labels(1, A.DAYS))


_NATIVE = tuple(0.4 + 11.0 * i for i in range(1, 51))


@query(
    """WITH axis AS (SELECT DISTINCT p_size - 1 AS depth_idx, 0.4 + 11.0 * p_size AS depth FROM part),
targets AS (SELECT label, depth AS target FROM axis_depth),
near AS (SELECT label, arg_min(depth_idx, abs(depth - target) * 1000000 - depth / 1000000) AS depth_idx FROM targets, (SELECT i - 1 AS depth_idx, 0.4 + 11.0 * i AS depth FROM (SELECT unnest(range(1, 51)) AS i)) GROUP BY label)
SELECT label, CAST(depth_idx AS INT) AS depth_idx, count(*) AS n, round(avg(p_retailprice), 6) AS mean FROM near JOIN (SELECT p_size - 1 AS depth_idx, p_retailprice FROM part) USING (depth_idx) GROUP BY ALL""",
    "axis_depth",
)
def nearest_depth_select(spark, sf_dir):
    p = A.table(spark, sf_dir, "part").select((F.col("p_size") - 1).cast("int").alias("depth_idx"), "p_retailprice")
    out = select_levels(p, nearest_levels(_NATIVE, SCORE_DEPTHS), label="label")
    return rounded(out.groupBy("label", "depth_idx").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("mean")), "mean")


_IBI = regions.IBI.bounds


@query(
    f"SELECT first_day, lead_day, depth_idx, CAST(lat_idx - 1 AS INT) AS lat_idx, CAST(lon_idx - 1 AS INT) AS lon_idx, {settled_sql('c_value')} AS c_value FROM grid_cells JOIN axis_lat USING (lat_idx) JOIN axis_lon USING (lon_idx) WHERE latitude BETWEEN {_IBI.minimum_latitude} AND {_IBI.maximum_latitude} AND longitude BETWEEN {_IBI.minimum_longitude} AND {_IBI.maximum_longitude}",
    "grid_cells", "axis_lat", "axis_lon",
)
def region_subset_grid(spark, sf_dir):
    from brinemark.model import Axes, Cube

    cube = Cube(Axes(A.LATITUDE, A.LONGITUDE, A.DEPTH), levels=A.grid_cells(spark, sf_dir).drop("r_value"))
    return regions.subset_cube(cube, "ibi").levels.select("first_day", "lead_day", "depth_idx", "lat_idx", "lon_idx", settled("c_value").alias("c_value"))


@query(f"SELECT obs_id, latitude, longitude FROM obs_points WHERE latitude BETWEEN {_IBI.minimum_latitude} AND {_IBI.maximum_latitude} AND longitude BETWEEN {_IBI.minimum_longitude} AND {_IBI.maximum_longitude}", "obs_points")
def region_subset_points(spark, sf_dir):
    return regions.subset_points(A.obs_points(spark, sf_dir), "ibi").select("obs_id", "latitude", "longitude")


@query(
    f"WITH p AS (SELECT obs_id, latitude, (longitude + 360) % 360 AS longitude FROM obs_points) SELECT * FROM p WHERE latitude BETWEEN {_IBI.minimum_latitude} AND {_IBI.maximum_latitude} AND (longitude >= {_IBI.minimum_longitude % 360} OR longitude <= {_IBI.maximum_longitude % 360})",
    "obs_points",
)
def region_wrap_longitude(spark, sf_dir):
    p = A.obs_points(spark, sf_dir).select("obs_id", "latitude", F.expr("pmod(longitude, 360D)").alias("longitude"))
    return regions.subset_points(p, "ibi")


@query(
    """WITH t AS (SELECT o_orderdate AS time, CAST(o_custkey % 4 AS INT) AS first_day, o_totalprice AS v FROM orders),
n AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY first_day ORDER BY time) - 1 AS INT) AS lead_day FROM t)
SELECT first_day, lead_day, count(*) AS n, round(avg(v), 6) AS mean FROM n WHERE lead_day < 10 GROUP BY ALL"""
)
def lead_day_renumber(spark, sf_dir):
    t = A.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("time"), F.expr("CAST(o_custkey % 4 AS INT)").alias("first_day"), F.col("o_totalprice").alias("v"))
    return rounded(ingest.renumbered(t, A.DAYS).groupBy("first_day", "lead_day").agg(F.count("*").alias("n"), F.avg("v").alias("mean")), "mean")


@query(
    """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS time FROM events),
l AS (SELECT first_day, CAST(i AS INT) AS lead_day, CAST(first_day + CAST(i AS INT) AS DATE) AS day FROM forecast_starts, (SELECT unnest(range(10)) AS i))
SELECT first_day, lead_day, count(*) AS n, round(avg(value), 6) AS mean FROM l JOIN events ON CAST(ts AS DATE) = day GROUP BY ALL""",
    "forecast_starts",
)
def reference_weeks(spark, sf_dir):
    series = A.table(spark, sf_dir, "events").select(F.col("ts").alias("time"), "value")
    out = ingest.weeks_of_series(series, A.forecast_starts(spark, sf_dir), A.DAYS)
    return rounded(out.groupBy("first_day", "lead_day").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "mean")


@query("SELECT s_nationkey, min(s_suppkey) AS position, arg_min(s_name, s_suppkey) AS name FROM supplier GROUP BY s_nationkey")
def dedupe_axis(spark, sf_dir):
    s = A.table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_suppkey").alias("position"), F.col("s_name").alias("name"))
    return ingest.without_duplicates(s, "s_nationkey", "position")


@query("SELECT CAST(d AS DATE) AS first_day, strftime(CAST(d AS DATE) + 1, '%Y%m%d') AS stored FROM (SELECT unnest(generate_series(DATE '2024-01-03', DATE '2024-12-25', INTERVAL 7 DAYS)) AS d)")
def weekly_start_dates(spark, sf_dir):
    from brinemark.sources import catalog

    return catalog.stored_names(spark, catalog.CHALLENGERS["glo12"])


@query("SELECT CAST(d AS DATE) AS month FROM (SELECT unnest(generate_series(DATE '1993-01-01', DATE '2019-12-01', INTERVAL 1 MONTH)) AS d)")
def monthly_series(spark, sf_dir):
    from brinemark.sources import catalog

    return catalog.months(spark)




@query(
    f"""WITH t AS (SELECT first_day, lead_day, depth_idx, lat_idx, lon_idx, {settled_sql('c_value')} AS thetao FROM grid_cells WHERE (lat_idx + lon_idx) % 3 <> 0),
s AS (SELECT first_day, lead_day, depth_idx, lat_idx, lon_idx, {settled_sql('r_value')} AS so FROM grid_cells WHERE (lat_idx + lon_idx) % 3 <> 1)
SELECT * FROM t FULL JOIN s USING (first_day, lead_day, depth_idx, lat_idx, lon_idx)""",
    "grid_cells",
)
def variable_merge(spark, sf_dir):
    g, keys = A.grid_cells(spark, sf_dir), list(ingest.CELL)
    t = g.where("(lat_idx + lon_idx) % 3 <> 0").select(*keys, settled("c_value").alias("thetao"))
    s = g.where("(lat_idx + lon_idx) % 3 <> 1").select(*keys, settled("r_value").alias("so"))
    return ingest.merged([t, s])


@query(
    "SELECT variable, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT 'sea_water_potential_temperature' AS variable, c_value AS value FROM grid_cells UNION ALL SELECT 'sea_water_salinity', r_value FROM grid_cells) GROUP BY variable",
    "grid_cells",
)
def standard_names_concat(spark, sf_dir):
    g = ingest.standard_names(A.grid_cells(spark, sf_dir).withColumnsRenamed({"c_value": "thetao", "r_value": "so"}))
    parts = [g.select(F.lit(v).alias("variable"), F.col(v).alias("value")) for v in (TEMPERATURE, SALINITY)]
    return ingest.concatenated(parts).groupBy("variable").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _matched(spark, sf_dir) -> DataFrame:
    return class4.match_forecasts(A.obs_points(spark, sf_dir), A.forecast_starts(spark, sf_dir), A.DAYS)


@query("SELECT obs_id, first_day, lead_day FROM matched", "matched")
def obs_forecast_match(spark, sf_dir):
    return _matched(spark, sf_dir).select("obs_id", "first_day", "lead_day")


@query(
    """WITH f AS (SELECT first_day + INTERVAL 6 HOURS AS first_day FROM forecast_starts)
SELECT o.obs_id, f.first_day, CAST(floor(date_diff('microsecond', f.first_day, o.time) / 86400000000.0) AS INT) AS lead_day FROM obs_points o JOIN f ON o.time >= f.first_day AND o.time < f.first_day + INTERVAL 10 DAYS""",
    "obs_points", "forecast_starts",
)
def obs_forecast_match_any_start(spark, sf_dir):
    starts = A.forecast_starts(spark, sf_dir).select((F.col("first_day").cast("timestamp_ntz") + F.expr("INTERVAL 6 HOURS")).alias("first_day"))
    return class4.match_any_start(A.obs_points(spark, sf_dir), starts, A.DAYS).select("obs_id", "first_day", "lead_day")


@query("SELECT obs_id, first_day, lead_day FROM matched", "matched")
def obs_sliding_windows(spark, sf_dir):
    last = "2024-01-24"
    out = matched_stream(A.obs_points(spark, sf_dir), "2024-01-03", 7, A.DAYS)
    return out.where(f"first_day <= DATE '{last}'").select("obs_id", "first_day", "lead_day")


_BINS = "WHEN {d} >= 300 AND {d} < 600 THEN '300-600m' WHEN {d} >= 100 AND {d} < 300 THEN '100-300m' WHEN {d} >= 5 AND {d} < 100 THEN '5-100m' WHEN {d} >= 0 AND {d} < 5 THEN '0-5m' END".format(d="depth")
_TBIN = f"CASE WHEN depth >= -1 AND depth < 1 THEN 'surface' {_BINS}"


@query(f"SELECT obs_id, depth_bin FROM (SELECT obs_id, CASE {_BINS} AS depth_bin FROM obs_points) WHERE depth_bin IS NOT NULL", "obs_points")
def obs_depth_bins(spark, sf_dir):
    return class4.binned(A.obs_points(spark, sf_dir), SALINITY).select("obs_id", "depth_bin")


@query(f"SELECT obs_id, depth_bin FROM (SELECT obs_id, {_TBIN} AS depth_bin FROM obs_points) WHERE depth_bin IS NOT NULL", "obs_points")
def obs_temperature_bins(spark, sf_dir):
    return class4.binned(A.obs_points(spark, sf_dir), TEMPERATURE).select("obs_id", "depth_bin")


@query(
    """WITH o AS (SELECT date_trunc('day', time) AS time, latitude, CAST(0 AS DOUBLE) AS longitude, first_day, lead_day, depth, obs_value AS v FROM matched),
m AS (SELECT time, latitude, longitude, first_day, lead_day, depth, avg(v) AS v FROM o GROUP BY ALL),
g AS (SELECT time, latitude, longitude, first_day, lead_day, max(depth) FILTER (depth <= 15) AS a, arg_max(v, depth) FILTER (depth <= 15) AS va, min(depth) FILTER (depth >= 15) AS b, arg_min(v, depth) FILTER (depth >= 15) AS vb FROM m GROUP BY ALL)
SELECT CAST(time AS TIMESTAMP) AS time, latitude, first_day, lead_day, round(CASE WHEN abs(a - b) <= 1e-8 + 1e-5 * abs(b) THEN va ELSE va + (15 - a) / (b - a) * (vb - va) END, 6) AS observation_value FROM g WHERE a IS NOT NULL AND b IS NOT NULL""",
    "matched",
)
def obs_velocity_15m(spark, sf_dir):
    o = _matched(spark, sf_dir).select(F.date_trunc("day", "time").cast("timestamp_ntz").alias("time"), "latitude", F.lit(0.0).alias("longitude"), "first_day", "lead_day", "depth", F.col("obs_value").alias("observation_value"))
    return rounded(class4.at_target_depth(o).select("time", "latitude", "first_day", "lead_day", "observation_value"), "observation_value")


@query(f"SELECT first_day, lead_day, lat_idx, lon_idx, {settled_sql('(c_ssh - (lat_idx * 8 + lon_idx) / 100.0 + 0.1148)')} AS sla FROM surface_cells", "surface_cells")
def sla_conversion(spark, sf_dir):
    out = class4.anomaly(A.surface_cells(spark, sf_dir).drop("r_ssh"), A.topography(spark, sf_dir), "c_ssh")
    return out.select("first_day", "lead_day", "lat_idx", "lon_idx", settled("c_ssh").alias("sla"))


_CORNERS = """q AS (SELECT obs_id, first_day, lead_day, depth, obs_value, CAST(least(floor((latitude - 24.5) / 4), 6) AS INT) AS i, CAST(least(floor((longitude + 22) / 4), 6) AS INT) AS j, latitude, longitude FROM matched WHERE latitude BETWEEN 24.5 AND 52.5 AND longitude BETWEEN -22 AND 6),
w AS (SELECT *, (latitude - (24.5 + 4 * i)) / 4 AS u, (longitude - (-22.0 + 4 * j)) / 4 AS v FROM q),
k AS (SELECT w.*, CAST(i + a AS INT) AS lat_idx, CAST(j + b AS INT) AS lon_idx, (CASE WHEN a = 1 THEN u ELSE 1 - u END) * (CASE WHEN b = 1 THEN v ELSE 1 - v END) AS weight FROM w, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS c(a, b))"""


@query(f"WITH {_CORNERS}, s AS (SELECT obs_id, first_day, lead_day, sum(weight * c_ssh) AS x, count(c_ssh) AS n FROM k JOIN surface_masked USING (first_day, lead_day, lat_idx, lon_idx) GROUP BY ALL) SELECT obs_id, first_day, lead_day, " + settled_sql("x") + " AS model_value FROM s WHERE n = 4", "matched", "surface_masked")
def bilinear_sample(spark, sf_dir):
    out = class4.bilinear(_matched(spark, sf_dir), A.surface_cells(spark, sf_dir, masked=True), "c_ssh", A.LATITUDE, A.LONGITUDE, ["obs_id", "first_day", "lead_day"])
    return out.withColumn("model_value", settled("model_value"))


_BRACKET = f"""{_CORNERS},
hi AS (SELECT obs_id, min(depth_idx) AS h FROM (SELECT obs_id, depth AS q FROM obs_points) JOIN axis_depth ON axis_depth.depth >= q GROUP BY obs_id),
lv AS (SELECT k.*, coalesce(h, 5) AS b, CASE WHEN h IS NULL THEN 5 WHEN h = 0 OR d.depth = k.depth THEN h ELSE h - 1 END AS a FROM k LEFT JOIN hi USING (obs_id) LEFT JOIN axis_depth d ON d.depth_idx = h),
lz AS (SELECT lv.*, CASE WHEN a = b THEN 0 ELSE (lv.depth - x.depth) / (y.depth - x.depth) END AS z FROM lv JOIN axis_depth x ON x.depth_idx = a JOIN axis_depth y ON y.depth_idx = b),
s AS (SELECT lz.obs_id, lz.first_day, lz.lead_day, any_value(lz.depth) AS depth, any_value(obs_value) AS obs_value, sum(weight * ((1 - z) * p.c_value + z * r.c_value)) AS x, count(p.c_value + r.c_value) AS n
 FROM lz LEFT JOIN grid_cells p ON p.first_day = lz.first_day AND p.lead_day = lz.lead_day AND p.lat_idx = lz.lat_idx AND p.lon_idx = lz.lon_idx AND p.depth_idx = a
 LEFT JOIN grid_cells r ON r.first_day = lz.first_day AND r.lead_day = lz.lead_day AND r.lat_idx = lz.lat_idx AND r.lon_idx = lz.lon_idx AND r.depth_idx = b GROUP BY lz.obs_id, lz.first_day, lz.lead_day)"""


def _bracketed(spark, sf_dir) -> DataFrame:
    return class4.sample_bracket(_matched(spark, sf_dir), A.grid_cells(spark, sf_dir), "c_value", A.LATITUDE, A.LONGITUDE, A.DEPTH, ["obs_id", "first_day", "lead_day"])


@query(f"WITH {_BRACKET} SELECT obs_id, first_day, lead_day, {settled_sql('x')} AS model_value FROM s WHERE n = 4", "matched", "grid_cells", "axis_depth")
def vertical_bracket(spark, sf_dir):
    return _bracketed(spark, sf_dir).withColumn("model_value", settled("model_value"))


# Second derivatives of the spline: elimination upwards (up), substitution downwards (down), by level of each profile.
_SPLINE = f"""RECURSIVE {_CORNERS},
flat AS (SELECT obs_id, first_day, lead_day, depth_idx, any_value(depth) AS q, sum(weight * c_value) AS y FROM k JOIN grid_cells USING (first_day, lead_day, lat_idx, lon_idx) GROUP BY obs_id, first_day, lead_day, depth_idx HAVING count(*) = 4),
pr AS (SELECT obs_id, first_day, lead_day, q, y, axis_depth.depth AS x, row_number() OVER g AS i, count(*) OVER (PARTITION BY obs_id, first_day, lead_day) AS n FROM flat JOIN axis_depth USING (depth_idx) WINDOW g AS (PARTITION BY obs_id, first_day, lead_day ORDER BY axis_depth.depth)),
hs AS (SELECT *, lead(x) OVER g - x AS h, (lead(y) OVER g - y) / (lead(x) OVER g - x) AS s, x - lag(x) OVER g AS h0, (y - lag(y) OVER g) / (x - lag(x) OVER g) AS s0 FROM pr WHERE n >= 4 WINDOW g AS (PARTITION BY obs_id, first_day, lead_day ORDER BY i)),
up AS (SELECT obs_id, first_day, lead_day, i, n, h, 2 * (h0 + h) AS b, 6 * (s - s0) AS r FROM hs WHERE i = 2
 UNION ALL SELECT a.obs_id, a.first_day, a.lead_day, a.i, a.n, a.h, 2 * (a.h0 + a.h) - a.h0 / up.b * a.h0, 6 * (a.s - a.s0) - a.h0 / up.b * up.r FROM up JOIN hs a ON a.obs_id = up.obs_id AND a.first_day = up.first_day AND a.lead_day = up.lead_day AND a.i = up.i + 1 WHERE a.i < a.n),
down AS (SELECT obs_id, first_day, lead_day, n AS i, CAST(0 AS DOUBLE) AS m FROM hs WHERE i = n
 UNION ALL SELECT u.obs_id, u.first_day, u.lead_day, u.i, (u.r - u.h * down.m) / u.b FROM down JOIN up u ON u.obs_id = down.obs_id AND u.first_day = down.first_day AND u.lead_day = down.lead_day AND u.i = down.i - 1),
z AS (SELECT hs.*, coalesce(m, 0) AS m FROM hs LEFT JOIN down USING (obs_id, first_day, lead_day, i)),
e AS (SELECT *, lead(x) OVER g AS x1, lead(y) OVER g AS y1, lead(m) OVER g AS m1, max(x) OVER (PARTITION BY obs_id, first_day, lead_day) AS last FROM z WINDOW g AS (PARTITION BY obs_id, first_day, lead_day ORDER BY i))"""


@query(f"WITH {_SPLINE} SELECT obs_id, first_day, lead_day, {settled_sql('((m * power(x1 - q, 3) + m1 * power(q - x, 3)) / (6 * h) + (y / h - m * h / 6) * (x1 - q) + (y1 / h - m1 * h / 6) * (q - x))')} AS model_value FROM e WHERE q >= x AND (q < x1 OR (q = x1 AND x1 = last))", "matched", "grid_cells", "axis_depth")
def salinity_natural_spline(spark, sf_dir):
    out = class4.sample_spline(_matched(spark, sf_dir), A.grid_cells(spark, sf_dir), "c_value", A.LATITUDE, A.LONGITUDE, A.DEPTH, ["obs_id", "first_day", "lead_day"])
    return out.withColumn("model_value", settled("model_value"))


def _pairs(spark, sf_dir) -> DataFrame:
    points = class4.binned(_matched(spark, sf_dir), TEMPERATURE).withColumnRenamed("obs_value", "observation_value")
    return points.join(_bracketed(spark, sf_dir), ["obs_id", "first_day", "lead_day"])


_CLASS4 = f"{_BRACKET}, p AS (SELECT lead_day, {_TBIN} AS depth_bin, x, obs_value FROM s WHERE n = 4), c AS (SELECT depth_bin, lead_day, sqrt(avg(power(x - obs_value, 2))) AS rmsd, count(*) AS n FROM p WHERE depth_bin IS NOT NULL GROUP BY ALL)"


@query(f"WITH {_CLASS4} SELECT depth_bin, lead_day, round(rmsd, 6) AS rmsd, n FROM c", "matched", "grid_cells", "axis_depth")
def class4_rmsd(spark, sf_dir):
    return rounded(class4.point_deviations(_pairs(spark, sf_dir)), "rmsd")


@query(f"WITH {_CLASS4} SELECT 'Temperature (°C) [{TEMPERATURE}]{{' || depth_bin || '}}' AS label, {_pivot('rmsd')} FROM c GROUP BY depth_bin", "matched", "grid_cells", "axis_depth")
def class4_table(spark, sf_dir):
    scored = class4.point_deviations(_pairs(spark, sf_dir)).withColumn("variable", F.lit(TEMPERATURE))
    return rounded(class4.point_table(scored, A.DAYS), *labels.lead_day_labels(1, A.DAYS))


@query("SELECT variable, depth, label FROM (VALUES " + ", ".join(f"('{v}', '{d}', '{('Sea level anomaly' if v == SSH else n.capitalize())} ({u}) [{v}]{{{d}}}')" for v, (n, u) in DISPLAY.items() for d in ("surface", "15m")) + ") AS t(variable, depth, label)")
def score_labels(spark, sf_dir):
    rows = spark.createDataFrame([(v, d) for v in DISPLAY for d in ("surface", "15m")], "variable string, depth string")
    return rows.withColumn("label", labels.row_label(F.col("variable"), F.col("depth"), points=True))


_COLUMN = """x AS (SELECT first_day, lead_day, lat_idx, lon_idx, depth_idx, depth, c_value, r_value, 1020 + c_value / 100 + depth_idx * 0.01 AS c_density, 1020 + r_value / 100 + depth_idx * 0.01 AS r_density FROM grid_cells JOIN axis_depth USING (depth_idx) WHERE depth <= 600),
z AS (SELECT *, max(c_density) FILTER (depth_idx = 0) OVER cell AS c0, max(r_density) FILTER (depth_idx = 0) OVER cell AS r0 FROM x WINDOW cell AS (PARTITION BY first_day, lead_day, lat_idx, lon_idx)),
m AS (SELECT first_day, lead_day, lat_idx, lon_idx, CASE WHEN count(*) FILTER (depth_idx = 0) > 0 THEN coalesce(min(depth) FILTER (c_density - c0 >= 0.03), max(depth)) END AS c_mld, CASE WHEN count(*) FILTER (depth_idx = 0) > 0 THEN coalesce(min(depth) FILTER (r_density - r0 >= 0.03), max(depth)) END AS r_mld FROM z GROUP BY ALL)"""


def _mld(spark, sf_dir, side: str) -> DataFrame:
    return stencil.mixed_layer(A.columns_of_water(spark, sf_dir), f"{side}_value", f"{side}_density")


@query(f"WITH {_COLUMN} SELECT first_day, lead_day, lat_idx, lon_idx, c_mld AS mld FROM m", "grid_cells", "axis_depth")
def mixed_layer_depth(spark, sf_dir):
    return _mld(spark, sf_dir, "c").withColumnRenamed(MLD, "mld")


def _surface_scores(c: DataFrame, r: DataFrame, variables: list[str]) -> DataFrame:
    own = lambda df: keyed(df).withColumn("depth", F.lit("surface")).select(*rmsd.KEYS, *variables)
    return rounded(rmsd.deviations(own(c), own(r), variables), "rmsd")


@query(f"WITH {_COLUMN}, e AS (SELECT first_day, lead_day, sqrt(avg(power(c_mld - r_mld, 2))) AS x FROM m GROUP BY ALL) SELECT '{MLD}' AS variable, 'surface' AS depth, lead_day, round(avg(x), 6) AS rmsd FROM e GROUP BY lead_day", "grid_cells", "axis_depth")
def mld_rmsd(spark, sf_dir):
    return _surface_scores(_mld(spark, sf_dir, "c"), _mld(spark, sf_dir, "r"), [MLD])


_double = lambda x: f"CAST('{x!r}' AS DOUBLE)"


def _monomials(coefficients: dict[str, float], *xs: str) -> str:
    return "(" + " + ".join(" * ".join([_double(c), *[f"power({x}, {p})" for x, p in zip(xs, powers, strict=True) if p != "0"]]) for powers, c in coefficients.items()) + ")"


_DENSITY = f"""g AS (SELECT first_day, lead_day, depth_idx, lat_idx, lon_idx, depth, (30 + c_value / 2) * ({_double(seawater.UPS)}) AS sa, 2 + r_value * 2 AS t FROM grid_cells JOIN axis_depth USING (depth_idx)),
th AS (SELECT *, t + depth * ({' + '.join(' * '.join([_double(c), *xs]) for c, xs in zip(seawater.THETA, ((), ('s1',), ('depth',), ('t',), ('t', 's1'), ('t', 't'), ('t', 'depth')), strict=True))}) AS theta FROM (SELECT *, sa / {_double(seawater.UPS)} AS s1 FROM g)),
ct AS (SELECT *, {_monomials(seawater.POTENTIAL_ENTHALPY, f'sqrt({_double(seawater.SALINITY_SCALE)} * sa)', 'theta / 40')} / {_double(seawater.HEAT_CAPACITY)} AS ct FROM th)"""


@query(
    f"WITH {_DENSITY} SELECT first_day, lead_day, depth_idx, lat_idx, lon_idx, depth, round(1 / {_monomials({k[:2]: v for k, v in seawater.SPECIFIC_VOLUME.items() if k[2] == '0'}, f'sqrt({_double(seawater.SALINITY_SCALE)} * sa + {_double(seawater.SALINITY_OFFSET)})', 'ct / 40')}, 6) AS density FROM ct",
    "grid_cells", "axis_depth",
)
def density_teos10(spark, sf_dir):
    g = with_axis(A.grid_cells(spark, sf_dir), A.DEPTH, "depth_idx", "depth").select("first_day", "lead_day", "depth_idx", "lat_idx", "lon_idx", "depth", F.expr("30 + c_value / 2").alias("salinity"), F.expr("2 + r_value * 2").alias("temperature"))
    return rounded(with_potential_density(g, "salinity", "temperature", "depth"), "density").drop("salinity", "temperature")


def _geo(spark, sf_dir, side: str) -> DataFrame:
    return stencil.geostrophic(A.surface_cells(spark, sf_dir, masked=True), A.LATITUDE, A.LONGITUDE, f"{side}_ssh")


_GEO = """full_grid AS (SELECT f.first_day, CAST(l.l AS INT) AS lead_day, lat_idx, lon_idx, latitude FROM forecast_starts f, (SELECT unnest(range(10)) AS l) l, axis_lat, axis_lon),
g AS (SELECT first_day, lead_day, lat_idx, lon_idx, latitude, c_ssh, r_ssh FROM full_grid LEFT JOIN surface_masked USING (first_day, lead_day, lat_idx, lon_idx)),
n AS (SELECT *, lag(c_ssh) OVER x AS cw, lead(c_ssh) OVER x AS ce, lag(c_ssh) OVER y AS cs, lead(c_ssh) OVER y AS cn, lag(r_ssh) OVER x AS rw, lead(r_ssh) OVER x AS re, lag(r_ssh) OVER y AS rs, lead(r_ssh) OVER y AS rn FROM g
  WINDOW x AS (PARTITION BY first_day, lead_day, lat_idx ORDER BY lon_idx), y AS (PARTITION BY first_day, lead_day, lon_idx ORDER BY lat_idx)),
d AS (SELECT *, 2 * 7.2921e-5 * sin(radians(latitude)) AS f, 4.0 * pi() / 180 * 6371000 AS dy, 4.0 * pi() / 180 * 6371000 * cos(radians(latitude)) AS dx,
  CASE WHEN lon_idx = 0 THEN ce - c_ssh WHEN lon_idx = 7 THEN c_ssh - cw ELSE (ce - cw) / 2 END AS cx, CASE WHEN lat_idx = 0 THEN cn - c_ssh WHEN lat_idx = 7 THEN c_ssh - cs ELSE (cn - cs) / 2 END AS cy,
  CASE WHEN lon_idx = 0 THEN re - r_ssh WHEN lon_idx = 7 THEN r_ssh - rw ELSE (re - rw) / 2 END AS rx, CASE WHEN lat_idx = 0 THEN rn - r_ssh WHEN lat_idx = 7 THEN r_ssh - rs ELSE (rn - rs) / 2 END AS ry FROM n),
v AS (SELECT first_day, lead_day, lat_idx, lon_idx, -9.81 / f * cy / dy AS c_east, 9.81 / f * cx / dx AS c_north, -9.81 / f * ry / dy AS r_east, 9.81 / f * rx / dx AS r_north FROM d WHERE abs(latitude) > 0.5)"""


@query(f"WITH {_GEO} SELECT first_day, lead_day, lat_idx, lon_idx, round(c_east, 9) AS eastward, round(c_north, 9) AS northward FROM v WHERE c_east IS NOT NULL OR c_north IS NOT NULL", "surface_masked", "forecast_starts", "axis_lat", "axis_lon")
def geostrophic_currents(spark, sf_dir):
    out = _geo(spark, sf_dir, "c").withColumnsRenamed({GEO_EASTWARD: "eastward", GEO_NORTHWARD: "northward"})
    return out.where("eastward IS NOT NULL OR northward IS NOT NULL").withColumns({c: F.round(c, 9) for c in ("eastward", "northward")})


@query(
    f"WITH {_GEO}, e AS (SELECT first_day, lead_day, sqrt(avg(power(c_east - r_east, 2))) AS xe, sqrt(avg(power(c_north - r_north, 2))) AS xn FROM v GROUP BY ALL) SELECT '{GEO_EASTWARD}' AS variable, 'surface' AS depth, lead_day, round(avg(xe), 6) AS rmsd FROM e GROUP BY lead_day UNION ALL SELECT '{GEO_NORTHWARD}', 'surface', lead_day, round(avg(xn), 6) FROM e GROUP BY lead_day",
    "surface_masked", "forecast_starts", "axis_lat", "axis_lon",
)
def geostrophic_rmsd(spark, sf_dir):
    return _surface_scores(_geo(spark, sf_dir, "c"), _geo(spark, sf_dir, "r"), [GEO_EASTWARD, GEO_NORTHWARD])


_VALUES = lambda rows: "(VALUES " + ", ".join(f"({a}, {b}, CAST({w!r} AS DOUBLE))" for a, b, w in rows) + ")"


@query(
    f"WITH a AS (SELECT * FROM {_VALUES(weights(A.FINE_LATITUDE, degree_axis(A.FINE_LATITUDE)))} AS t(lat_idx, i, u)), b AS (SELECT * FROM {_VALUES(weights(A.FINE_LONGITUDE, degree_axis(A.FINE_LONGITUDE)))} AS t(lon_idx, j, v)) SELECT first_day, lead_day, CAST(i AS INT) AS lat_idx, CAST(j AS INT) AS lon_idx, CASE WHEN count(c_ssh) = 4 THEN {settled_sql('sum(u * v * c_ssh)')} END AS c_ssh FROM surface_masked JOIN a USING (lat_idx) JOIN b USING (lon_idx) GROUP BY first_day, lead_day, i, j",
    "surface_masked",
)
def regrid_one_degree(spark, sf_dir):
    s = A.surface_cells(spark, sf_dir, masked=True).drop("r_ssh")
    out = interpolate(s, ["c_ssh"], A.FINE_LATITUDE, A.FINE_LONGITUDE, ["first_day", "lead_day"])
    return out.withColumn("c_ssh", settled("c_ssh"))


_OCEAN = "o AS (SELECT lat_idx, lon_idx FROM surface_masked WHERE lead_day = 0 AND first_day = (SELECT min(first_day) FROM surface_masked))"


def _ocean(spark, sf_dir) -> DataFrame:
    return lagrangian.ocean_points(A.surface_cells(spark, sf_dir, masked=True), "c_ssh")


@query(f"WITH {_OCEAN} SELECT * FROM o", "surface_masked")
def ocean_points(spark, sf_dir):
    return _ocean(spark, sf_dir)


@query(f"WITH {_OCEAN}, n AS (SELECT count(*) FILTER (lat_idx >= 1 AND lon_idx BETWEEN 1 AND 6) AS regional, count(*) AS whole FROM o) SELECT regional, whole, CAST(least(regional, greatest(20, round_even(100.0 * regional / whole, 0))) AS BIGINT) AS particles FROM n", "surface_masked")
def particle_count(spark, sf_dir):
    o = _ocean(spark, sf_dir)
    regional, whole = o.where("lat_idx >= 1 AND lon_idx BETWEEN 1 AND 6").count(), o.count()
    return spark.createDataFrame([(regional, whole, lagrangian.particle_count(regional, whole, 100, 20))], "regional long, whole long, particles long")


# What the generator of the seeds draws from so many points: number of points, particle, rank of its point.
_DRAWN = ", ".join(f"({n}, {i}, {k})" for n in range(1, 65) for i, k in enumerate(np.random.RandomState(PARTICLE_SEED).choice(n, min(n, 30), replace=False)))


@query(f"WITH {_OCEAN}, p AS (SELECT *, row_number() OVER (ORDER BY lat_idx, lon_idx) - 1 AS rank, count(*) OVER () AS n FROM o) SELECT CAST(pid AS INT) AS pid, lat_idx, lon_idx FROM p JOIN (VALUES {_DRAWN}) AS d(n, pid, rank) USING (n, rank)", "surface_masked")
def particle_seed_sample(spark, sf_dir):
    return lagrangian.seeds(_ocean(spark, sf_dir), 30)


def _particles(spark, sf_dir) -> DataFrame:
    at = lagrangian.seeds(_ocean(spark, sf_dir), 30)
    at = with_axis(at, A.LATITUDE, "lat_idx", "latitude")
    return with_axis(at, A.LONGITUDE, "lon_idx", "longitude").select("pid", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


def _drift(spark, sf_dir, side: str) -> DataFrame:
    s = A.surface_cells(spark, sf_dir, masked=True)
    uv = s.select("first_day", F.lit(side).alias("side"), "lead_day", "lat_idx", "lon_idx", (F.col(f"{side}_ssh") / 10).alias("u"), (F.col(f"{side}_ssh") / 20 - 0.2).alias("v"))
    return lagrangian.trajectories(uv, _particles(spark, sf_dir), A.LATITUDE, A.LONGITUDE, A.DAYS)


@query()
def lagrangian_deviation(spark, sf_dir):
    return rounded(lagrangian.mean_deviation(_drift(spark, sf_dir, "c"), _drift(spark, sf_dir, "r")), "deviation")


@query(
    """WITH a AS (SELECT CAST(l_orderkey % 4 AS INT) AS first_day, CAST(l_partkey % 50 AS INT) AS pid, CAST(l_suppkey % 10 AS INT) AS day, avg(l_quantity) AS lat, avg(l_extendedprice / 1000) AS lon, avg(l_quantity * (1 - l_discount)) AS rlat, avg(l_extendedprice * (1 - l_tax) / 1000) AS rlon FROM lineitem GROUP BY 1, 2, 3),
e AS (SELECT first_day, day, avg(sqrt(power((lat - rlat) * 111, 2) + power((lon - rlon) * 111 * cos(radians(rlat)), 2))) AS d FROM a GROUP BY ALL)
SELECT day, round(avg(d), 6) AS deviation FROM e GROUP BY day"""
)
def trajectory_distance(spark, sf_dir):
    x = A.table(spark, sf_dir, "lineitem").groupBy(F.expr("CAST(l_orderkey % 4 AS INT)").alias("first_day"), F.expr("CAST(l_partkey % 50 AS INT)").alias("pid"), F.expr("CAST(l_suppkey % 10 AS INT)").alias("day"))
    x = x.agg(F.avg("l_quantity").alias("lat"), F.expr("avg(l_extendedprice / 1000)").alias("lon"), F.expr("avg(l_quantity * (1 - l_discount))").alias("rlat"), F.expr("avg(l_extendedprice * (1 - l_tax) / 1000)").alias("rlon"))
    reference = x.select("first_day", "pid", "day", F.col("rlat").alias("lat"), F.col("rlon").alias("lon"))
    return rounded(lagrangian.mean_deviation(x.select("first_day", "pid", "day", "lat", "lon"), reference), "deviation")


@query(
    """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'odd label' WHEN p_size % 2 = 0 THEN 'Surface height' ELSE 'Northward velocity' END AS display_name, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'm' END AS unit, CASE WHEN p_size % 5 = 0 THEN 'unknown' ELSE p_brand END AS standard_name, CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 3 = 0 THEN '' ELSE '50m' END AS depth FROM part"""
)
def score_labels_parse(spark, sf_dir):
    p = A.table(spark, sf_dir, "part").select("p_partkey", F.expr("CASE WHEN p_size % 5 = 0 THEN 'odd label' ELSE concat(CASE WHEN p_size % 2 = 0 THEN 'Surface height' ELSE 'Northward velocity' END, ' (m) [', p_brand, ']', CASE WHEN p_size % 3 = 0 THEN '' ELSE '{50m}' END) END").alias("label"))
    return p.select("p_partkey", *[c.alias(n) for n, c in labels.parsed_label(F.col("label")).items()])


_NAMES = "Height,Surface height,Northward velocity,EASTWARD VELOCITY,Northward geostrophic velocity,Eastward geostrophic velocity,Salinity"


@query("SELECT p_partkey, CASE lower(n) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.RENAMES.items()) + f" ELSE lower(n) END AS display_name FROM (SELECT p_partkey, split_part('{_NAMES}', ',', CAST(p_size % 7 + 1 AS INT)) AS n FROM part)")
def score_display_names(spark, sf_dir):
    p = A.table(spark, sf_dir, "part").select("p_partkey", F.expr(f"split_part('{_NAMES}', ',', CAST(p_size % 7 + 1 AS INT))").alias("n"))
    return p.select("p_partkey", labels.current_display_name(F.col("n")).alias("display_name"))




@query("SELECT challenger, depth, 'temperature' AS variable, metric AS standard_name, '°C' AS unit, lead_day, CASE WHEN value < 0 THEN NULL ELSE value END AS value FROM scores WHERE variable = 'temperature'", "scores")
def score_table_rows(spark, sf_dir):
    s = A.scores(spark, sf_dir).where("variable = 'temperature'")
    printed = s.select("challenger", F.expr("concat('Temperature (°C) [', metric, ']{', lower(depth), '}')").alias("label"), F.expr("concat('Lead day ', lead_day)").alias("header"), F.expr("CASE WHEN value < 0 THEN 'nan?' ELSE CAST(value AS STRING) END").alias("value"))
    return scores.parse_rows(printed)


_BASE = "b AS (SELECT metric, depth, variable, lead_day, value AS base FROM scores WHERE challenger = 'glo12'), j AS (SELECT s.*, base, CASE WHEN base <> 0 THEN (value - base) / abs(base) * 100 END AS p FROM scores s LEFT JOIN b USING (metric, depth, variable, lead_day))"


@query(
    f"WITH {_BASE} SELECT challenger, metric, depth, variable, lead_day, round(p, 6) AS percent, CASE WHEN base IS NULL THEN NULL WHEN base = 0 THEN (CASE WHEN value = 0 THEN '0%' ELSE 'N/A' END) ELSE (CASE WHEN p > 0 THEN '+' ELSE '' END) || CAST(CAST(floor(p + 0.5) AS BIGINT) AS VARCHAR) || '%' END AS text FROM j",
    "scores",
)
def score_percent_diff(spark, sf_dir):
    return rounded(scores.against_baseline(A.scores(spark, sf_dir), "glo12").select("challenger", "metric", "depth", "variable", "lead_day", "percent", "text"), "percent")


@query(
    f"WITH {_BASE} SELECT challenger, metric, depth, variable, lead_day, CASE WHEN base IS NULL THEN NULL " + " ".join(f"WHEN coalesce(p, 0) <= {e} THEN {i}" for i, e in enumerate(scores.colour_edges())) + " ELSE 11 END AS bin FROM j",
    "scores",
)
def score_color_bins(spark, sf_dir):
    return scores.against_baseline(A.scores(spark, sf_dir), "glo12").select("challenger", "metric", "depth", "variable", "lead_day", "bin")


@query(
    """WITH h AS (SELECT *, list(lead_day) OVER (PARTITION BY challenger, depth, variable) AS days FROM scores)
SELECT challenger, depth, variable, lead_day, value, CASE WHEN lead_day = '2' THEN '1' WHEN lead_day = '9' THEN '10' ELSE lead_day END AS slot FROM h
WHERE lead_day IN ('1', '3', '5', '7', '10') OR (lead_day = '2' AND NOT list_contains(days, '1')) OR (lead_day = '9' AND NOT list_contains(days, '10'))""",
    "scores",
)
def score_display_lead_days(spark, sf_dir):
    return scores.display_days(A.scores(spark, sf_dir)).drop("metric")


@query("SELECT DISTINCT challenger, CASE WHEN ends_with(challenger, '_1_degree') THEN 'one_degree' ELSE 'high_resolution' END AS track FROM scores", "scores")
def score_tracks(spark, sf_dir):
    return A.scores(spark, sf_dir).select("challenger", scores.track(F.col("challenger")).alias("track")).distinct()


@query("WITH t AS (SELECT challenger, CASE WHEN ends_with(challenger, '_1_degree') THEN 'one_degree' ELSE 'high_resolution' END AS track FROM scores) SELECT track, CASE WHEN bool_or(challenger = 'glo12') THEN 'glo12' WHEN bool_or(challenger = 'glo12_1_degree') THEN 'glo12_1_degree' ELSE min(challenger) END AS baseline FROM t GROUP BY track", "scores")
def score_baselines(spark, sf_dir):
    names = score_tracks(spark, sf_dir).orderBy("challenger").collect()  # challengers are a handful
    of = {}
    for r in names:
        of.setdefault(r.track, []).append(r.challenger)
    return spark.createDataFrame([(t, scores.baseline_of(c)) for t, c in of.items()], "track string, baseline string")


@query(
    """WITH d AS (SELECT challenger, depth, variable, string_agg('"' || lead_day || '":' || coalesce(CAST(value AS VARCHAR), 'null'), ',' ORDER BY lead_day) AS j FROM scores GROUP BY ALL),
v AS (SELECT challenger, depth, string_agg('"' || variable || '":{"standard_name":"' || variable || '","unit":"m","data":{' || j || '}}', ',' ORDER BY variable) AS j FROM d GROUP BY ALL)
SELECT challenger, '{"name":"' || challenger || '","depths":{' || string_agg('"' || depth || '":{"variables":{' || j || '}}', ',' ORDER BY depth) || '}}' AS document FROM v GROUP BY challenger""",
    "scores",
)
def nested_score_document(spark, sf_dir):
    s = A.scores(spark, sf_dir).withColumns({"standard_name": F.col("variable"), "unit": F.lit("m")})
    return scores.as_json(scores.nested(s))


@query(
    """WITH d AS (SELECT DISTINCT challenger, depth, variable FROM scores), n AS (SELECT challenger, count(DISTINCT depth) AS k FROM d GROUP BY 1), c AS (SELECT challenger, variable, count(*) AS m FROM d GROUP BY ALL)
SELECT challenger, coalesce(string_agg(variable, ',' ORDER BY variable) FILTER (m = k), '') AS shared, coalesce(string_agg(variable, ',' ORDER BY variable) FILTER (m < k), '') AS partial FROM c JOIN n USING (challenger) GROUP BY challenger""",
    "scores",
)
def score_depth_variables(spark, sf_dir):
    return scores.depth_variables(A.scores(spark, sf_dir)).select("challenger", F.concat_ws(",", "shared").alias("shared"), F.concat_ws(",", "partial").alias("partial"))


@query("SELECT DISTINCT c_mktsegment AS challenger, n_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND c_mktsegment <> 'BUILDING'")
def report_coverage(spark, sf_dir):
    t = lambda n: A.table(spark, sf_dir, n)
    reports = t("customer").join(t("nation"), F.expr("c_nationkey = n_nationkey")).select(F.col("n_name").alias("region"), F.col("c_mktsegment").alias("challenger"))
    known = t("nation").where("n_regionkey = 1").select(F.col("n_name").alias("region"))
    names = t("customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_mktsegment").alias("challenger")).distinct()
    return scores.report_coverage(known, names, reports).select("challenger", "region")


@query("SELECT c_custkey, lower(c_mktsegment) AS challenger, CASE WHEN c_nationkey % 2 = 0 THEN 'ibi' ELSE 'global' END AS region, 'm' || c_nationkey AS metric FROM customer")
def report_names(spark, sf_dir):
    from brinemark.sources.reports import report_parts

    c = A.table(spark, sf_dir, "customer")
    path = F.concat(F.lit("/out/"), F.lower("c_mktsegment"), F.when(F.col("c_nationkey") % 2 == 0, F.lit(".ibi")).otherwise(F.lit(".global")), F.lit(".report/m"), F.col("c_nationkey").cast("string"), F.lit("/part-0"))
    return c.select("c_custkey", *[x.alias(n) for n, x in report_parts(path).items()])


@query("WITH s AS (SELECT DISTINCT challenger FROM scores) SELECT challenger, CASE challenger WHEN 'glo12' THEN 'Global 1/12' ELSE challenger END AS display_name, CASE challenger WHEN 'glo12' THEN 'centre' ELSE '' END AS organisation FROM s", "scores")
def challenger_metadata_lookup(spark, sf_dir):
    metadata = spark.createDataFrame([("glo12", "Global 1/12", "centre"), ("other", "Other", "x")], "challenger string, display_name string, organisation string")
    return scores.with_metadata(A.scores(spark, sf_dir).select("challenger").distinct(), metadata, "challenger", ("display_name", "organisation"), "display_name")


@query("WITH v AS (SELECT DISTINCT p_size % 3 || '.' || p_size % 12 || CASE WHEN p_size % 4 = 0 THEN '.rc' ELSE '.1' END AS version FROM part) SELECT version, CAST(row_number() OVER (ORDER BY list_transform(string_split(version, '.'), lambda x: coalesce(TRY_CAST(x AS INT), -1)) DESC) AS INT) AS place FROM v")
def version_order(spark, sf_dir):
    from pyspark.sql import Window as W

    v = A.table(spark, sf_dir, "part").select(F.expr("concat(p_size % 3, '.', p_size % 12, CASE WHEN p_size % 4 = 0 THEN '.rc' ELSE '.1' END)").alias("version")).distinct()
    return v.withColumn("place", F.row_number().over(W.orderBy(scores.version_key(F.col("version")).desc())))


@query(
    """WITH d AS (SELECT p_brand, list_sort(list(DISTINCT round(p_size * CAST(1.00037 AS DOUBLE), 3))) AS l FROM part GROUP BY p_brand)
SELECT p_brand, substr(sha256(array_to_string(list_transform(l, lambda x: printf('%.3f', x)), ',')), 1, 12) AS grid FROM d"""
)
def depth_grid_hash(spark, sf_dir):
    d = A.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set(F.round(F.col("p_size") * 1.00037, 3))).alias("l"))
    return d.select("p_brand", depth_grid_hash_column(F.col("l")).alias("grid"))


@query("SELECT obs_id, strftime(time, '%Y%m%d') AS day, CAST(floor(date_diff('microsecond', TIMESTAMP '2024-01-03', time) / 86400000000.0) AS INT) AS lead_day FROM obs_points WHERE time >= TIMESTAMP '2024-01-03'", "obs_points")
def observation_days(spark, sf_dir):
    o = A.obs_points(spark, sf_dir).where("time >= TIMESTAMP_NTZ '2024-01-03 00:00:00'")
    return o.select("obs_id", F.date_format("time", "yyyyMMdd").alias("day"), binning.lead_day(F.col("time"), F.lit("2024-01-03").cast("date")).alias("lead_day"))


from brinemark.plans import cubes  # noqa: E402  it adds the queries on whole cubes

__all__ = ["ORACLES", "QUERIES", "cubes"]
