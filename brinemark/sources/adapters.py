"""The verification model's tables made from general star-schema tables, for the queries of the catalogue.

Grid: 4 forecasts x 10 lead days x 6 depths x 8 latitudes x 8 longitudes; a cell without a line item is land.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinemark.model import EASTWARD, NORTHWARD, SALINITY, SSH, TEMPERATURE, Axes, Cube

LATITUDE = tuple(24.5 + 4 * i for i in range(8))
LONGITUDE = tuple(-22.0 + 4 * i for i in range(8))
DEPTH = (0.494025, 47.37369, 92.32607, 222.4752, 318.1274, 541.0889)
#: A grid with steps under a degree, for regridding.
FINE_LATITUDE = tuple(24.1 + 0.4 * i for i in range(8))
FINE_LONGITUDE = tuple(-22.3 + 0.4 * i for i in range(8))
FORECASTS, DAYS = 4, 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forecast_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").where(f"n_nationkey < {FORECASTS}")
    return n.select(F.expr("date_add(DATE '2024-01-03', CAST(7 * n_nationkey AS INT))").alias("first_day"))


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first_day, lead_day, depth_idx, lat_idx, lon_idx, c_value (challenger), r_value (reference)."""
    x = table(spark, sf_dir, "lineitem").select(
        F.expr("date_add(DATE '2024-01-03', CAST(7 * (l_orderkey % 4) AS INT))").alias("first_day"),
        F.expr("CAST(l_suppkey % 10 AS INT)").alias("lead_day"),
        F.expr("CAST((l_linenumber - 1) % 6 AS INT)").alias("depth_idx"),
        F.expr("CAST(l_partkey % 8 AS INT)").alias("lat_idx"),
        F.expr("CAST(CAST(l_quantity AS INT) % 8 AS INT)").alias("lon_idx"),
        "l_extendedprice",
        "l_discount",
    )
    return x.groupBy("first_day", "lead_day", "depth_idx", "lat_idx", "lon_idx").agg(F.expr("avg(l_extendedprice / 10000)").alias("c_value"), F.expr("avg(l_extendedprice * (1 - l_discount) / 10000)").alias("r_value"))


def surface_cells(spark: SparkSession, sf_dir: str, masked: bool = False) -> DataFrame:
    out = grid_cells(spark, sf_dir).where("depth_idx = 0").select("first_day", "lead_day", "lat_idx", "lon_idx", F.col("c_value").alias("c_ssh"), F.col("r_value").alias("r_ssh"))
    return out.where("(3 * lat_idx + 5 * lon_idx) % 11 <> 0") if masked else out


def obs_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("obs_id"),
        F.col("ts").alias("time"),
        F.expr("24.5D + CAST(user_id % 113 AS DOUBLE) / 4").alias("latitude"),
        F.expr("-22.0D + CAST(event_id % 113 AS DOUBLE) / 4").alias("longitude"),
        F.col("value").alias("depth"),
        F.expr("CAST(get_json_object(props, '$.k') AS DOUBLE) / 10").alias("obs_value"),
    )


def topography(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (table(spark, sf_dir, "nation").where("n_nationkey < 8").select(F.col("n_nationkey").cast("int").alias(x)) for x in ("lat_idx", "lon_idx"))
    return a.join(F.broadcast(b), F.lit(True)).withColumn("mdt", (F.col("lat_idx") * 8 + F.col("lon_idx")) / 100.0)


def columns_of_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grid_cells with depth, temperatures and densities of both sides; density grows with depth and value."""
    from brinemark.operators.axes import with_axis

    g = with_axis(grid_cells(spark, sf_dir), DEPTH, "depth_idx", "depth").drop("depth_key")
    return g.withColumns({"c_density": F.expr("1020D + c_value / 100 + depth_idx * 0.01D"), "r_density": F.expr("1020D + r_value / 100 + depth_idx * 0.01D")})


def cubes(spark: SparkSession, sf_dir: str) -> tuple[Cube, Cube]:
    """A challenger and a reference with all variables, made from grid_cells."""
    axes, g = Axes(LATITUDE, LONGITUDE, DEPTH), grid_cells(spark, sf_dir)
    at = ["first_day", "lead_day", "lat_idx", "lon_idx"]

    def own(value: str) -> Cube:
        v = F.col(value)
        levels = g.select(*at, "depth_idx", v.alias(TEMPERATURE), (30 + v / 2).alias(SALINITY), (v / 10).alias(NORTHWARD), (v / 20 - 0.1).alias(EASTWARD))
        return Cube(axes, levels, g.where("depth_idx = 0").select(*at, v.alias(SSH)), DAYS)

    return own("c_value"), own("r_value")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of challengers by metric, depth, variable and lead day, made from nations and suppliers."""
    s = table(spark, sf_dir, "supplier").select(
        F.expr("CASE CAST(s_nationkey % 4 AS INT) WHEN 0 THEN 'glo12' WHEN 1 THEN 'glonet' WHEN 2 THEN 'xihe_1_degree' ELSE 'glo12_1_degree' END").alias("challenger"),
        F.lit("rmsd_variables").alias("metric"),
        F.expr("CASE CAST(s_suppkey % 2 AS INT) WHEN 0 THEN 'Surface' ELSE '50m' END").alias("depth"),
        F.expr("CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN 'temperature' WHEN 1 THEN 'salinity' ELSE 'zonal current' END").alias("variable"),
        F.expr("CAST(s_suppkey % 10 + 1 AS INT)").alias("day"),
        "s_acctbal",
    )
    return s.groupBy("challenger", "metric", "depth", "variable", "day").agg(F.expr("round(avg(s_acctbal) / 1000, 3)").alias("value")).select("challenger", "metric", "depth", "variable", F.col("day").cast("string").alias("lead_day"), "value")


# The same tables in DuckDB SQL, as common table expressions.
SQL = {
    "forecast_starts": "SELECT CAST(DATE '2024-01-03' + CAST(7 * n_nationkey AS INT) AS DATE) AS first_day FROM nation WHERE n_nationkey < 4",
    "axis_lat": "SELECT CAST(i AS INT) AS lat_idx, 24.5 + 4.0 * i AS latitude FROM (SELECT unnest(range(8)) AS i)",
    "axis_lon": "SELECT CAST(i AS INT) AS lon_idx, -22.0 + 4.0 * i AS longitude FROM (SELECT unnest(range(8)) AS i)",
    "axis_depth": "SELECT depth_idx, CAST(depth AS DOUBLE) AS depth, label FROM (VALUES " + ", ".join(f"({i}, {d}, '{x}')" for i, (d, x) in enumerate(zip(DEPTH, ("surface", "50m", "100m", "200m", "300m", "500m"), strict=True))) + ") AS t(depth_idx, depth, label)",
    "grid_cells": """SELECT CAST(DATE '2024-01-03' + CAST(7 * (l_orderkey % 4) AS INT) AS DATE) AS first_day, CAST(l_suppkey % 10 AS INT) AS lead_day,
        CAST((l_linenumber - 1) % 6 AS INT) AS depth_idx, CAST(l_partkey % 8 AS INT) AS lat_idx, CAST(CAST(l_quantity AS INT) % 8 AS INT) AS lon_idx,
        AVG(l_extendedprice / 10000) AS c_value, AVG(l_extendedprice * (1 - l_discount) / 10000) AS r_value FROM lineitem GROUP BY 1, 2, 3, 4, 5""",
    "surface_cells": "SELECT first_day, lead_day, lat_idx, lon_idx, c_value AS c_ssh, r_value AS r_ssh FROM grid_cells WHERE depth_idx = 0",
    "surface_masked": "SELECT * FROM surface_cells WHERE (3 * lat_idx + 5 * lon_idx) % 11 <> 0",
    "obs_points": """SELECT event_id AS obs_id, ts AS time, 24.5 + CAST(user_id % 113 AS DOUBLE) / 4 AS latitude, -22.0 + CAST(event_id % 113 AS DOUBLE) / 4 AS longitude,
        value AS depth, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10 AS obs_value FROM events""",
    "matched": """SELECT o.*, f.first_day, CAST(floor(date_diff('microsecond', CAST(f.first_day AS TIMESTAMP), o.time) / 86400000000.0) AS INT) AS lead_day
        FROM obs_points o JOIN forecast_starts f ON o.time >= f.first_day AND o.time < f.first_day + INTERVAL 10 DAYS""",
    "scores": """SELECT challenger, metric, depth, variable, CAST(day AS VARCHAR) AS lead_day, value FROM (
        SELECT CASE CAST(s_nationkey % 4 AS INT) WHEN 0 THEN 'glo12' WHEN 1 THEN 'glonet' WHEN 2 THEN 'xihe_1_degree' ELSE 'glo12_1_degree' END AS challenger, 'rmsd_variables' AS metric,
        CASE CAST(s_suppkey % 2 AS INT) WHEN 0 THEN 'Surface' ELSE '50m' END AS depth, CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN 'temperature' WHEN 1 THEN 'salinity' ELSE 'zonal current' END AS variable,
        CAST(s_suppkey % 10 + 1 AS INT) AS day, round(avg(s_acctbal) / 1000, 3) AS value FROM supplier GROUP BY 1, 2, 3, 4, 5)""",
}
_NEEDS = {"surface_cells": ["grid_cells"], "surface_masked": ["grid_cells", "surface_cells"], "matched": ["obs_points", "forecast_starts"]}


def with_views(query: str, *names: str) -> str:
    """The query with the tables it names as common table expressions."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*_NEEDS.get(n, []), n] if x not in order]
    own = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    rest = query.strip()
    start = next((x for x in ("WITH RECURSIVE ", "WITH ") if rest.upper().startswith(x)), "")
    return f"{start}{own}, {rest[len(start):]}" if start else f"WITH {own} {rest}"
