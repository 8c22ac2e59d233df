"""The nine metrics. Each returns the score table: label and a column for each lead day."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinemark.functions.labels import lead_day_labels
from brinemark.model import GEO_EASTWARD, GEO_NORTHWARD, GRID_VARIABLES, MLD, POINT_ORDER, Cube
from brinemark.operators import class4, lagrangian
from brinemark.operators.regions import Region, subset_cube, subset_points
from brinemark.operators.rmsd import cube_rmsd, score_table
from brinemark.operators.stencil import geostrophic_cube, mixed_layer_cube
from brinemark.sources import catalog

RegionLike = str | Region | None
LAGRANGIAN_LABEL = "Lagrangian trajectory deviation (km) []{surface}"


def variables(challenger: Cube, reference: Cube, region: RegionLike = None) -> DataFrame:
    a, b = subset_cube(challenger, region), subset_cube(reference, region)
    return score_table(cube_rmsd(a, b, GRID_VARIABLES), GRID_VARIABLES, challenger.lead_days)


def mixed_layer_depth(challenger: Cube, reference: Cube, region: RegionLike = None, density: Callable | None = None) -> DataFrame:
    a, b = (mixed_layer_cube(subset_cube(x, region), density) for x in (challenger, reference))
    return score_table(cube_rmsd(a, b, [MLD]), [MLD], challenger.lead_days)


def geostrophic_currents(challenger: Cube, reference: Cube, region: RegionLike = None) -> DataFrame:
    """The region is cut first, so gradients at its edge are one-sided."""
    both = [GEO_NORTHWARD, GEO_EASTWARD]
    a, b = (geostrophic_cube(subset_cube(x, region)) for x in (challenger, reference))
    return score_table(cube_rmsd(a, b, both), both, challenger.lead_days)


def lagrangian_trajectories(challenger: Cube, reference: Cube, region: RegionLike = None) -> DataFrame:
    a, b = subset_cube(challenger, region), subset_cube(reference, region)
    n = lagrangian.PARTICLES
    if a is not challenger:
        n = lagrangian.particle_count(lagrangian.ocean_points(a.surface).count(), lagrangian.ocean_points(challenger.surface).count())
    scores = lagrangian.cube_deviation(a, b, n)
    names = lead_day_labels(2, challenger.lead_days - 1)
    cells = [F.first(F.when(F.col("lead_day") == i + 1, F.col("deviation")), ignorenulls=True).alias(x) for i, x in enumerate(names)]
    return scores.agg(*cells).select(F.lit(LAGRANGIAN_LABEL).alias("label"), *names)


def observations(challenger: Cube, points: DataFrame, topography: DataFrame | None = None, region: RegionLike = None) -> DataFrame:
    """The points are matched once for all variables; the scores, a row for each variable and bin, come back to the driver."""
    cube, points = subset_cube(challenger, region), subset_points(points, region)
    matched = class4.match_forecasts(points, cube.surface.select("first_day"), cube.lead_days).persist()
    try:
        each = [class4.variable_deviations(cube, matched, v, topography) for v in POINT_ORDER if v in points.columns]
        scores = reduce(DataFrame.unionByName, [x.select("variable", "depth_bin", "lead_day", "rmsd", "n") for x in each])
        table = class4.point_table(scores, cube.lead_days)
        return table.sparkSession.createDataFrame(table.collect(), table.schema)
    finally:
        matched.unpersist()


def rmsd_of_variables_compared_to_observations(challenger: Cube, region: RegionLike = None, root: str | None = None) -> DataFrame:
    spark = challenger.surface.sparkSession
    if not catalog.are_observed(challenger):
        return spark.createDataFrame([(f"Observations are available from {catalog.FIRST_OBSERVATION} on",)], "Message string")
    topography = catalog.mean_topography(spark, challenger.axes.resolution(), root)
    return observations(challenger, catalog.observations(spark, challenger, root), topography, region)


def _against(reference: str, metric: Callable[..., DataFrame], name: str) -> Callable[..., DataFrame]:
    def compared(challenger: Cube, region: RegionLike = None, root: str | None = None, stage_folder: str | None = None) -> DataFrame:
        other = catalog.open_reference(challenger.surface.sparkSession, reference, challenger, root)
        return metric(challenger, catalog.staged(other, stage_folder) if stage_folder else other, region)

    compared.__name__ = compared.__qualname__ = name
    compared.__doc__ = f"{metric.__name__} against {reference}, read from root at the challenger's resolution."
    return compared


for _start, _metric in (("rmsd_of_variables", variables), ("rmsd_of_mixed_layer_depth", mixed_layer_depth), ("rmsd_of_geostrophic_currents", geostrophic_currents), ("deviation_of_lagrangian_trajectories", lagrangian_trajectories)):
    for _reference in catalog.REFERENCES:
        _full = f"{_start}_compared_to_{_reference}"
        globals()[_full] = _against(_reference, _metric, _full)

ALL = (
    "rmsd_of_variables_compared_to_observations",
    *(f"{m}_compared_to_{r}" for r in catalog.REFERENCES for m in ("rmsd_of_variables", "rmsd_of_mixed_layer_depth", "rmsd_of_geostrophic_currents", "deviation_of_lagrangian_trajectories")),
)
