"""The session every entry point of the library starts from."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "brinemark", master: str | None = None, workers: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC. workers: tasks at once where no master is set at all.

    On a cluster the master, memory and checkpoint folder come from spark-submit; only
    what is unset there is set here.
    """
    builder = SparkSession.builder.appName(app)
    master = master or os.environ.get("SPARK_MASTER")
    if not master and workers and "PYSPARK_GATEWAY_PORT" not in os.environ and not SparkSession.getActiveSession():  # spark-submit has set one
        master = f"local[{workers}]"
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # a join whose partitions have all turned out small hashes them instead of sorting
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
