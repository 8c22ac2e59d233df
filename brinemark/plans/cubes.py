"""Queries on whole cubes, and on rules that only their corners show."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinemark import metrics
from brinemark.functions import labels
from brinemark.model import DISPLAY, EASTWARD, GEO_EASTWARD, GEO_NORTHWARD, GRID_VARIABLES, MLD, NORTHWARD, SALINITY, SSH, SURFACE_VARIABLES, TEMPERATURE, Axes
from brinemark.operators import class4, regions, rmsd, scores, stencil
from brinemark.operators.axes import at_depths
from brinemark.plans.catalogue import _CORNERS, _GEO, _IBI, _OCEAN, _matched, _pivot, query, rounded, settled, settled_sql
from brinemark.sources import adapters as A
from brinemark.sources import ingest

_OF = {SSH: "{x}_value", TEMPERATURE: "{x}_value", SALINITY: "(30 + {x}_value / 2)", NORTHWARD: "({x}_value / 10)", EASTWARD: "({x}_value / 20 - 0.1)"}


def _scored(where: str = "true") -> str:
    """Deviations of all variables of adapters.cubes on the cells that hold."""
    each = " UNION ALL ".join(
        f"SELECT first_day, lead_day, label AS depth, '{v}' AS variable, sqrt(avg(power({x.format(x='c')} - {x.format(x='r')}, 2))) AS x FROM grid_cells JOIN axis_depth USING (depth_idx) JOIN axis_lat USING (lat_idx) JOIN axis_lon USING (lon_idx) WHERE {where} AND ({'depth_idx = 0' if v in SURFACE_VARIABLES else 'true'}) GROUP BY ALL"
        for v, x in _OF.items()
    )
    return f"each AS ({each}), mean AS (SELECT variable, depth, lead_day, avg(x) AS rmsd FROM each GROUP BY ALL)"


_VIEWS = ("grid_cells", "axis_depth", "axis_lat", "axis_lon")
_IN_IBI = f"latitude BETWEEN {_IBI.minimum_latitude} AND {_IBI.maximum_latitude} AND longitude BETWEEN {_IBI.minimum_longitude} AND {_IBI.maximum_longitude}"
_LABEL = "CASE variable " + " ".join(f"WHEN '{v}' THEN '{DISPLAY[v][0].capitalize()} ({DISPLAY[v][1]}) [{v}]{{'" for v in _OF) + " END || depth || '}'"


@query(f"WITH {_scored()} SELECT variable, depth, lead_day, round(rmsd, 6) AS rmsd FROM mean", *_VIEWS)
def cube_rmsd_all_variables(spark, sf_dir):
    return rounded(rmsd.cube_rmsd(*A.cubes(spark, sf_dir), GRID_VARIABLES), "rmsd")


@query(f"WITH {_scored(_IN_IBI)} SELECT {_LABEL} AS label, {_pivot('rmsd')} FROM mean GROUP BY variable, depth", *_VIEWS)
def metric_variables_in_region(spark, sf_dir):
    return rounded(metrics.variables(*A.cubes(spark, sf_dir), "ibi"), *labels.lead_day_labels(1, A.DAYS))


_NEAR = tuple(0.5 + 60.0 * i for i in range(10))


@query(
    f"""WITH t AS (SELECT CAST(i AS INT) AS target, 0.5 + 60.0 * i AS d FROM (SELECT unnest(range({len(_NEAR)})) AS i)),
near AS (SELECT target, arg_min(depth_idx, abs(depth - d) * 1000000 - depth / 1000000) AS depth_idx FROM t, axis_depth GROUP BY target)
SELECT first_day, lead_day, target AS depth_idx, count(*) AS n, {settled_sql('avg(r_value)')} AS mean FROM near JOIN grid_cells USING (depth_idx) GROUP BY first_day, lead_day, target""",
    "grid_cells", "axis_depth",
)
def reference_at_challenger_depths(spark, sf_dir):
    levels = at_depths(A.cubes(spark, sf_dir)[1], _NEAR).levels
    return levels.groupBy("first_day", "lead_day", "depth_idx").agg(F.count("*").alias("n"), F.avg(TEMPERATURE).alias("mean")).withColumn("mean", settled("mean"))


_DEEP = (0.5, 100.0, 250.0, 599.9, 600.0, 900.0)


@query(
    f"""WITH d AS (SELECT * FROM (VALUES {', '.join(f'({i}, {d})' for i, d in enumerate(_DEEP))}) AS t(depth_idx, depth)),
x AS (SELECT first_day, lead_day, lat_idx, lon_idx, depth_idx, CAST(depth AS DOUBLE) AS depth, 1020 + c_value / 200 + depth_idx * 0.004 AS rho FROM grid_cells JOIN d USING (depth_idx) WHERE depth <= 600),
z AS (SELECT *, max(rho) FILTER (depth_idx = 0) OVER (PARTITION BY first_day, lead_day, lat_idx, lon_idx) AS top FROM x)
SELECT first_day, lead_day, lat_idx, lon_idx, CASE WHEN count(top) > 0 THEN coalesce(min(depth) FILTER (rho - top >= 0.03), max(depth)) END AS mld FROM z GROUP BY ALL""",
    "grid_cells",
)
def mixed_layer_depth_cap(spark, sf_dir):
    cube = replace(A.cubes(spark, sf_dir)[0], axes=Axes(A.LATITUDE, A.LONGITUDE, _DEEP))
    density = lambda rows: rows.withColumn("density", 1020 + F.col(TEMPERATURE) / 200 + F.col("depth_idx") * 0.004)
    return stencil.mixed_layer_cube(cube, density).surface.withColumnRenamed(MLD, "mld")


_TROPICS = tuple(-4.0 + i for i in range(8))


@query(
    f"""WITH {_GEO.replace('4.0 * pi() / 180 * 6371000 AS dy', '1.0 * pi() / 180 * 6371000 AS dy').replace('FROM d WHERE abs(latitude) > 0.5', 'FROM d WHERE latitude < -0.5 OR latitude > 0.5')}
SELECT first_day, lead_day, lat_idx, lon_idx, round(c_east, 9) AS eastward, round(c_north, 9) AS northward FROM v WHERE c_east IS NOT NULL OR c_north IS NOT NULL""".replace("axis_lat, axis_lon)", "tropics, axis_lon)").replace("WITH full_grid", "WITH tropics AS (SELECT CAST(i AS INT) AS lat_idx, i - 4.0 AS latitude FROM (SELECT unnest(range(8)) AS i)), full_grid"),
    "surface_masked", "forecast_starts", "axis_lat", "axis_lon",
)
def geostrophic_without_equator(spark, sf_dir):
    out = stencil.geostrophic(A.surface_cells(spark, sf_dir, masked=True), _TROPICS, A.LONGITUDE, "c_ssh").withColumnsRenamed({GEO_EASTWARD: "eastward", GEO_NORTHWARD: "northward"})
    return out.where("eastward IS NOT NULL OR northward IS NOT NULL").withColumns({c: F.round(c, 9) for c in ("eastward", "northward")})


@query(f"WITH {_CORNERS}, s AS (SELECT obs_id, first_day, lead_day, sum(weight * c_value) AS x, count(*) AS n FROM k JOIN grid_cells USING (first_day, lead_day, lat_idx, lon_idx) WHERE depth_idx = 0 GROUP BY ALL) SELECT obs_id, first_day, lead_day, {settled_sql('x')} AS model_value, {settled_sql('x')} AS spline_value FROM s WHERE n = 4", "matched", "grid_cells")
def single_depth_sample(spark, sf_dir):
    keys, top = ["obs_id", "first_day", "lead_day"], A.grid_cells(spark, sf_dir).where("depth_idx = 0")
    of = lambda f, name: f(_matched(spark, sf_dir), top, "c_value", A.LATITUDE, A.LONGITUDE, A.DEPTH[:1], keys, name=name)
    out = of(class4.sample_bracket, "model_value").join(of(class4.sample_spline, "spline_value"), keys)
    return out.withColumns({c: settled(c) for c in ("model_value", "spline_value")})


@query("SELECT obs_id, first_day, lead_day, CAST(first_day + lead_day AS DATE) AS day FROM matched", "matched")
def forecast_lookup(spark, sf_dir):
    known = class4.known_forecasts(_matched(spark, sf_dir), A.forecast_starts(spark, sf_dir))
    return ingest.with_time(known, "day").select("obs_id", "first_day", "lead_day", "day")


@query(
    f"WITH a AS (SELECT *, {settled_sql('c_value')} AS x FROM grid_cells WHERE (lat_idx + lon_idx) % 3 <> 0), b AS (SELECT *, {settled_sql('r_value')} AS y FROM grid_cells WHERE (lat_idx + lon_idx) % 3 <> 1) SELECT first_day, lead_day, depth_idx, lat_idx, lon_idx, x, y FROM a FULL JOIN b USING (first_day, lead_day, depth_idx, lat_idx, lon_idx)",
    "grid_cells",
)
def variable_merge_override(spark, sf_dir):
    g, keys = A.grid_cells(spark, sf_dir), list(ingest.CELL)
    a = g.where("(lat_idx + lon_idx) % 3 <> 0").select(*keys, settled("c_value").alias("x"))
    b = g.where("(lat_idx + lon_idx) % 3 <> 1").select(*keys, F.lit(0.0).alias("x"), settled("r_value").alias("y"))
    return ingest.merged([a, b], override=True)


@query("SELECT CAST(p_size AS INT) AS depth, min(p_partkey) AS position, CAST(row_number() OVER (ORDER BY min(p_partkey)) AS INT) AS place FROM part GROUP BY p_size")
def ordered_distinct_depths(spark, sf_dir):
    out = scores.ordered_distinct(A.table(spark, sf_dir, "part").select(F.col("p_size").cast("int").alias("depth"), F.col("p_partkey").alias("position")), "depth", "position")
    return out.withColumn("place", F.row_number().over(W.orderBy("position")))


@query("SELECT DISTINCT challenger, CAST(dense_rank() OVER (ORDER BY challenger <> 'glonet', challenger) AS INT) AS place FROM scores", "scores")
def score_baseline_order(spark, sf_dir):
    listed = scores.baseline_first(A.scores(spark, sf_dir).select("challenger").distinct(), "glonet", "challenger")
    rows = [r.challenger for r in listed.collect()]  # challengers are a handful
    return spark.createDataFrame([(c, i + 1) for i, c in enumerate(rows)], "challenger string, place int")


@query(f"WITH {_OCEAN} SELECT CAST(o.lat_idx - 1 AS INT) AS lat_idx, CAST(o.lon_idx - 1 AS INT) AS lon_idx FROM o JOIN axis_lat ON axis_lat.lat_idx = o.lat_idx JOIN axis_lon ON axis_lon.lon_idx = o.lon_idx WHERE {_IN_IBI}", "surface_masked", "axis_lat", "axis_lon")
def ocean_points_in_region(spark, sf_dir):
    from brinemark.operators.lagrangian import ocean_points

    s = A.surface_cells(spark, sf_dir, masked=True).withColumnRenamed("c_ssh", SSH)
    return ocean_points(regions.subset_cube(replace(A.cubes(spark, sf_dir)[0], surface=s), "ibi").surface)
