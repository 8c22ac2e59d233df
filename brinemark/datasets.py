"""Datasets by name. Each function takes a session and, unless set in the environment, the folder of the data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brinemark.model import Cube
from brinemark.sources import catalog


class challenger:
    """Forecast systems; each …_1_degree form is interpolated to degree centres."""


def _add(name: str, dataset: catalog.Dataset) -> None:
    def native(spark: SparkSession, root: str | None = None, preprocess: Callable[[DataFrame], DataFrame] | None = None) -> Cube:
        return catalog.open_cube(spark, dataset, root, preprocess=preprocess)

    def coarse(spark: SparkSession, root: str | None = None, preprocess: Callable[[DataFrame], DataFrame] | None = None) -> Cube:
        return catalog.open_cube(spark, dataset, root, "one_degree", preprocess)

    setattr(challenger, name, staticmethod(native))
    if dataset.one_degree:
        setattr(challenger, f"{name}_1_degree", staticmethod(coarse))


for _name, _dataset in catalog.CHALLENGERS.items():
    _add(_name, _dataset)


class reference:
    """Gridded references at the resolution of a challenger."""

    @staticmethod
    def glorys_reanalysis(spark: SparkSession, challenger: Cube, root: str | None = None) -> Cube:
        return catalog.open_reference(spark, "glorys_reanalysis", challenger, root)

    @staticmethod
    def glorys_reanalysis_1_degree(spark: SparkSession, root: str | None = None) -> DataFrame:
        """The monthly series of 1993 to 2019 at one degree."""
        return catalog.monthly_series(spark, root)

    @staticmethod
    def glo12_analysis(spark: SparkSession, challenger: Cube, root: str | None = None) -> Cube:
        return catalog.open_reference(spark, "glo12_analysis", challenger, root)


class input:  # noqa: A001
    """Fields that forecast systems start from."""

    @staticmethod
    def glo12_nowcasts(spark: SparkSession, root: str | None = None) -> DataFrame:
        return catalog.open_input(spark, "glo12_nowcasts", root)

    @staticmethod
    def ifs_forcings(spark: SparkSession, root: str | None = None) -> DataFrame:
        return catalog.open_input(spark, "ifs_forcings", root)
