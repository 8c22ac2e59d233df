"""Root-mean-square deviation of two cubes by variable, depth and lead day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinemark.functions.labels import lead_day_label, row_label
from brinemark.model import SCORE_DEPTHS, SURFACE_VARIABLES, Cube
from brinemark.operators.axes import nearest_levels, select_levels, with_axis

KEYS = ["first_day", "lead_day", "depth", "latitude_key", "longitude_key"]


def deviations(challenger: DataFrame, reference: DataFrame, variables: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """variable, depth, lead_day, rmsd: cells are aligned by keys, squares averaged over a forecast's cells without
    weights, missing values left out, and the roots averaged over forecasts.

    Both sides carry only keys and variables into the join. The first aggregate is partial on the map side, so the join is
    the only exchange of cells; tables bucketed by the keys spare it too.
    """
    each = _forecast_scores(challenger, reference, variables, list(keys), ["first_day", "lead_day", "depth"])
    return _mean_scores(each, variables)


def _forecast_scores(challenger: DataFrame, reference: DataFrame, variables: Sequence[str], keys: list[str], by: list[str]) -> DataFrame:
    c = challenger.select(*keys, *[F.col(v).cast("double").alias(f"c_{i}") for i, v in enumerate(variables)])
    r = reference.select(*keys, *[F.col(v).cast("double").alias(f"r_{i}") for i, v in enumerate(variables)])
    square = lambda i: F.pow(F.nanvl(F.col(f"c_{i}"), F.lit(None)) - F.nanvl(F.col(f"r_{i}"), F.lit(None)), 2)
    return c.join(r, keys).groupBy(*by).agg(*[F.sqrt(F.avg(square(i))).alias(f"x_{i}") for i in range(len(variables))])


def _mean_scores(each: DataFrame, variables: Sequence[str]) -> DataFrame:
    mean = each.groupBy("lead_day", "depth").agg(*[F.avg(f"x_{i}").alias(f"x_{i}") for i in range(len(variables))])
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"x_{i}").alias("rmsd")) for i, v in enumerate(variables)]))
    return mean.select("lead_day", "depth", pairs.alias("p")).select("p.variable", "depth", "lead_day", "p.rmsd")


def _prepared(cube: Cube, variables: Sequence[str], levels: dict[int, int] | None, by_index: bool) -> DataFrame:
    """first_day, slab (lead day and number of a level), cell (latitude and longitude) and variables.

    Integers sort, hash and travel several times faster than five columns with a label among them; first_day stays a column of
    its own, so that the forecasts of one side prune the files of the other. levels: the source level of each number, None for
    the surface; by_index: both sides have the same axes.
    """
    df = cube.surface.withColumn("_level", F.lit(0)) if levels is None else select_levels(cube.levels, levels, label="_level")
    if not by_index:
        df = with_axis(df, cube.axes.latitude, "lat_idx", "latitude")
        df = with_axis(df, cube.axes.longitude, "lon_idx", "longitude")
    row, column = ("lat_idx", "lon_idx") if by_index else ("latitude_key", "longitude_key")
    cell = F.col(row).cast("long") * (1 << 21) + F.col(column)
    return df.select("first_day", (F.col("lead_day") * 64 + F.col("_level")).alias("slab"), cell.alias("cell"), *variables)


def cube_rmsd(challenger: Cube, reference: Cube, variables: Sequence[str]) -> DataFrame:
    """variable, depth, lead_day, rmsd of two cubes; variables with levels at the score depths, others at the surface.

    Score depths that mean the same two levels share a number, so these levels are joined once and their labels come after the sums.
    """
    sides, out = (challenger, reference), []
    by_index = challenger.axes.latitude == reference.axes.latitude and challenger.axes.longitude == reference.axes.longitude
    flat = [v for v in variables if v in SURFACE_VARIABLES]
    deep = [v for v in variables if v not in SURFACE_VARIABLES]
    for vs, surface in ((flat, True), (deep, False)):
        if vs:
            near = [{x: 0 for x in SCORE_DEPTHS} if surface else nearest_levels(x.axes.depth, SCORE_DEPTHS) for x in sides]
            pairs = [(near[0][label], near[1][label]) for label in SCORE_DEPTHS][: 1 if surface else None]
            numbers = list(dict.fromkeys(pairs))
            labels = F.array(*[F.array(*[F.lit(label) for label, p in zip(SCORE_DEPTHS, pairs, strict=False) if p == n]) for n in numbers])
            c, r = (_prepared(x, vs, None if surface else {i: n[k] for i, n in enumerate(numbers)}, by_index) for k, x in enumerate(sides))
            each = _forecast_scores(c, r, vs, ["first_day", "slab", "cell"], ["first_day", "slab"])
            depth = F.explode(F.element_at(labels, (F.pmod("slab", F.lit(64)) + 1).cast("int"))).alias("depth")
            out.append(_mean_scores(each.select(F.shiftright("slab", 6).cast("int").alias("lead_day"), depth, *[f"x_{i}" for i in range(len(vs))]), vs))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def score_table(scores: DataFrame, variables: Sequence[str], lead_days: int, value: str = "rmsd", points: bool = False, depths: Sequence[str] = tuple(SCORE_DEPTHS)) -> DataFrame:
    """label and a column for each lead day, by depth and then variable as listed."""
    names = [lead_day_label(i) for i in range(lead_days)]
    order = lambda xs, c: F.array_position(F.array(*map(F.lit, xs)), F.col(c))
    cells = [F.first(F.when(F.col("lead_day") == i, F.col(value)), ignorenulls=True).alias(names[i]) for i in range(lead_days)]
    wide = scores.groupBy("variable", "depth").agg(*cells)
    first, second = (order(variables, "variable"), order(depths, "depth")) if points else (order(depths, "depth"), order(variables, "variable"))
    return wide.orderBy(first, second).select(row_label(F.col("variable"), F.col("depth"), points).alias("label"), *names)
