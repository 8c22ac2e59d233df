"""Coordinates: nearest levels, brackets on an axis, joins of cells with their coordinates."""

from __future__ import annotations

from collections.abc import Hashable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinemark.model import Cube

#: An axis longer than this isn't broadcast; a twelfth of a degree has 4320 points.
MAX_AXIS = 100_000


def axis_frame(spark: SparkSession, values: Sequence[float], index: str, name: str) -> DataFrame:
    """index, name and name_key (thousandths) of each coordinate."""
    rows = [(i, float(v), int(round(float(v) * 1000))) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"{index} int, {name} double, {name}_key int")


def with_axis(df: DataFrame, values: Sequence[float], index: str, name: str) -> DataFrame:
    """df with the coordinate of its index and the coordinate's key; cells outside the axis go."""
    axis = axis_frame(df.sparkSession, values, index, name)
    return df.join(F.broadcast(axis) if len(values) <= MAX_AXIS else axis, index)


def nearest_levels(axis: Sequence[float], targets: dict[Hashable, float]) -> dict[Hashable, int]:
    """For each target the index of the nearest level; of two as near the deeper one."""
    return {label: min(range(len(axis)), key=lambda i: (abs(axis[i] - t), -axis[i])) for label, t in targets.items()}


def select_levels(df: DataFrame, chosen: dict[Hashable, int], index: str = "depth_idx", label: str = "depth") -> DataFrame:
    """Rows of the chosen levels with their label; a level that serves several labels is repeated.

    The levels are literals, so the filter reaches the scan.
    """
    labels: dict[int, list] = {}
    for name, i in chosen.items():
        labels.setdefault(i, []).append(name)
    kept = df.where(F.col(index).isin(sorted(labels)))
    if all(len(x) == 1 for x in labels.values()):
        return kept.withColumn(label, F.create_map(*[F.lit(x) for i, names in labels.items() for x in (i, names[0])])[F.col(index)])
    lists = F.create_map(*[x for i, names in labels.items() for x in (F.lit(i), F.array(*map(F.lit, names)))])
    return kept.withColumn(label, F.explode(lists[F.col(index)]))


def at_depths(cube: Cube, depths: Sequence[float]) -> Cube:
    """The cube with a level for each of the depths, the nearest of its own; a level may serve several."""
    near = nearest_levels(cube.axes.depth, dict(enumerate(depths)))
    levels = select_levels(cube.levels, near, label="_to").withColumn("depth_idx", F.col("_to")).drop("_to")
    return replace(cube, levels=levels, axes=replace(cube.axes, depth=tuple(cube.axes.depth[near[i]] for i in range(len(depths)))))


def levels_until(q: Column, axis: Sequence[float], including: bool = True) -> Column:
    """How many of the axis' coordinates are less than q, or equal to it."""
    return F.size(F.filter(F.array(*[F.lit(float(x)) for x in axis]), lambda x: x <= q if including else x < q))


def interval(q: Column, axis: Sequence[float]) -> Column:
    """Index of the start of the interval of an ascending axis that holds q; null outside the axis.

    Evenly spaced axes need a division and two comparisons, others a search in a literal array.
    """
    n = len(axis)
    if n < 2:
        raise ValueError("Interpolation needs two coordinates at least")
    values = F.array(*[F.lit(float(x)) for x in axis])
    step = (axis[-1] - axis[0]) / (n - 1)
    if all(abs(axis[i] - (axis[0] + i * step)) < 0.25 * step for i in range(n)):
        guess = F.least(F.greatest(F.floor((q - axis[0]) / step), F.lit(0)), F.lit(n - 2)).cast("int")
        low = F.least(guess + F.when(F.get(values, guess + 1) <= q, 1).when(F.get(values, guess) > q, -1).otherwise(0), F.lit(n - 2))
    else:
        low = F.least(F.greatest(levels_until(q, axis) - 1, F.lit(0)), F.lit(n - 2))
    return F.when((q >= axis[0]) & (q <= axis[-1]), low)


def end_weight(q: Column, low: Column, axis: Sequence[float]) -> Column:
    """Weight of the end of the interval that starts at index low; low should be a column of its own, as it is named three times."""
    values = F.array(*[F.lit(float(x)) for x in axis])
    return (q - F.get(values, low)) / (F.get(values, low + 1) - F.get(values, low))


def bracket(q: Column, axis: Sequence[float]) -> tuple[Column, Column]:
    """(index of the interval's start, weight of its end) on an ascending axis; null outside the axis."""
    low = interval(q, axis)
    return low, end_weight(q, low, axis)
