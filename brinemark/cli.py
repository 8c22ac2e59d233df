"""Command line: brinemark evaluate CHALLENGER.py … [options]."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import dataclass, replace
from pathlib import Path

from brinemark import metrics
from brinemark.evaluate import challenger_from_file, evaluate_challenger, summary
from brinemark.operators.regions import load_region_file, resolve
from brinemark.session import session
from brinemark.sources import stage


@dataclass(frozen=True)
class Configuration:
    """Run settings; a field's variable is BRINEMARK_ and its name in capitals."""

    data: str = ""
    output: str = "."
    stage: str = ""
    stage_directory: str = ""
    workers: int = 4
    retries: int = 5
    keep_stage: bool = False

    @classmethod
    def resolved(cls, given: dict) -> Configuration:
        """What is given, else the environment, else the default."""
        out = cls()
        for name in cls.__dataclass_fields__:
            value = given.get(name)
            if value is None:
                value = os.environ.get(f"BRINEMARK_{name.upper()}")
            if value is not None:
                kind = type(getattr(out, name))
                out = replace(out, **{name: str(value).lower() in ("1", "true", "yes") if kind is bool else kind(value)})
        if out.workers < 1 or out.retries < 1:
            raise ValueError("workers and retries must be positive")
        return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("brinemark")
    e = p.add_subparsers(dest="command", required=True).add_parser("evaluate", help="run the metrics of challengers")
    e.add_argument("challengers", nargs="*", help="Python files that define challenger(spark)")
    e.add_argument("--all", metavar="FOLDER", help="every Python file of a folder")
    where = e.add_mutually_exclusive_group()
    where.add_argument("--region", help="an official region")
    where.add_argument("--region-file", help="a JSON file of a custom region")
    e.add_argument("--metric", action="append", choices=metrics.ALL, help="only these metrics")
    e.add_argument("--data", help="the folder of references and observations")
    e.add_argument("--output", help="where reports go")
    e.add_argument("--stage", help="what to stage, joined by commas: challenger, references")
    e.add_argument("--stage-directory")
    e.add_argument("--workers", type=int, help="concurrent tasks, where no master is set")
    e.add_argument("--retries", type=int, help="failures of a task before the run fails")
    e.add_argument("--keep-stage", action="store_const", const=True)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    configuration = Configuration.resolved(vars(args))
    files = [*args.challengers, *(sorted(map(str, Path(args.all).glob("*.py"))) if args.all else [])]
    if not files:
        print("No challenger", file=sys.stderr)
        return 2
    region = load_region_file(args.region_file) if args.region_file else resolve(args.region)
    stages = [x for x in dict.fromkeys(x.strip() for x in configuration.stage.split(",")) if x]
    spark = session(workers=configuration.workers, **{"spark.task.maxFailures": str(configuration.retries)})
    folder = configuration.stage_directory.rstrip("/")
    before = set(stage.children(spark, folder)) if stages and folder else set()
    reports = []
    for path in files:
        report = evaluate_challenger(spark, challenger_from_file(path), Path(path).stem, configuration.output, region, configuration.data or None, args.metric or metrics.ALL, stages, folder)
        reports.append(report)
        print(f"{'FAIL' if report.failed else 'OK'} {report.challenger} {report.region} {report.path}")
        for name, why in report.failed.items():
            print(f"  {name}: {why}", file=sys.stderr)
    good, bad = summary(reports)
    print(f"{good} succeeded, {bad} failed")
    if not bad and stages and not configuration.keep_stage:  # what this run has added, and nothing that was there
        stage.clear(spark, [f"{folder}/{x}" for x in stage.children(spark, folder) if x not in before])
    return int(bool(bad))


if __name__ == "__main__":
    sys.exit(main())
