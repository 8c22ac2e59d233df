"""An evaluation: the nine metrics of a challenger, written as tables."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from brinemark import metrics
from brinemark.model import Cube, Source
from brinemark.operators.regions import Region, resolve
from brinemark.operators.scores import report_name
from brinemark.sources import catalog


@dataclass
class Report:
    challenger: str
    region: str
    path: str
    done: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)


def challenger_from_file(path: str) -> Callable[[SparkSession], Cube]:
    """The function `challenger(spark)` of a Python file."""
    spec = importlib.util.spec_from_file_location(Path(path).stem, path)
    if spec is None or spec.loader is None or not Path(path).exists():
        raise ValueError(f"No Python file at {path}")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not callable(getattr(module, "challenger", None)):
        raise ValueError(f"{path} doesn't define challenger(spark)")
    return module.challenger


#: What can be staged: the challenger's cube, and the references at its resolution.
STAGES = ("challenger", "references")


def evaluate_challenger(spark: SparkSession, challenger: Callable[[SparkSession], Cube], name: str, output: str, region: str | Region | None = None, root: str | None = None, names: Sequence[str] = metrics.ALL, stages: Sequence[str] = (), stage_folder: str | None = None) -> Report:
    """Runs the metrics in order and writes <output>/<name>.<region>.report/<metric>; one that fails doesn't stop the others.

    stages: what is written to stage_folder once and read from there by every metric; it stays there for later runs.
    """
    if unknown := [s for s in stages if s not in STAGES]:
        raise ValueError(f"Can't stage {', '.join(unknown)}: choose from {', '.join(STAGES)}")
    if stages and not stage_folder:
        raise ValueError("Staging needs a folder")
    where = resolve(region)
    cube = challenger(spark)
    if "challenger" in stages:
        cube = catalog.staged(cube if cube.source else replace(cube, source=Source("challenger", name)), stage_folder)
    report = Report(name, where.id, f"{output.rstrip('/')}/{report_name(name, where.id)}")
    if cube.surface is not None:
        cube.surface.persist()
    for metric in names:
        try:
            extra = {"stage_folder": stage_folder} if "references" in stages and "observations" not in metric else {}
            table: DataFrame = getattr(metrics, metric)(cube, where, root, **extra)
            table.coalesce(1).write.mode("overwrite").json(f"{report.path}/{metric}")
            report.done.append(metric)
        except Exception as e:  # a metric's own failure is part of the report
            report.failed[metric] = f"{type(e).__name__}: {str(e)[:500]}"
    if cube.surface is not None:
        cube.surface.unpersist()
    return report


def summary(reports: Sequence[Report]) -> tuple[int, int]:
    """Challengers whose metrics all succeeded, and the others."""
    good = sum(not r.failed for r in reports)
    return good, len(reports) - good
