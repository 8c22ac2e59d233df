"""Stage: tables written once under a key and read from then on, in any store that Spark can write."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STALE_SECONDS, POLL_SECONDS = 24 * 3600, 5


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if it isn't there."""
    fs, at = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def publish(spark: SparkSession, part: str, path: str) -> None:
    """Give finished work its name at once."""
    fs, at = _file_system(spark, part)
    if not fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(path)):
        raise OSError(f"Can't move {part} to {path}")


def is_staged(spark: SparkSession, path: str) -> bool:
    """A stage counts once its writer has committed it."""
    return exists(spark, f"{path}/_SUCCESS")


def staged(spark: SparkSession, root: str, key: str, build) -> DataFrame:
    """The frame of a key; build() makes it if it isn't there. A write that fails leaves no commit mark, so it is done again."""
    path = f"{root.rstrip('/')}/{key}"
    with build_guard(spark, path):
        if not is_staged(spark, path):
            build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def clear(spark: SparkSession, paths: list[str]) -> None:
    """Delete these stages and nothing beside them."""
    for path in paths:
        fs, at = _file_system(spark, path)
        fs.delete(at, True)


@contextmanager
def build_guard(spark: SparkSession, path: str, stale: float = STALE_SECONDS, poll: float = POLL_SECONDS):
    """One of several drivers builds a stage at a time, by a file beside it; a file older than stale is taken over."""
    fs, lock = _file_system(spark, f"{path.rstrip('/')}.lock")
    fs.mkdirs(lock.getParent())
    while not _create(fs, lock):
        if fs.exists(lock) and time.time() - fs.getFileStatus(lock).getModificationTime() / 1000 > stale:
            fs.delete(lock, False)
        else:
            time.sleep(poll)
    try:
        yield
    finally:
        fs.delete(lock, False)


def _create(fs, lock) -> bool:
    try:
        return fs.createNewFile(lock)
    except Exception as e:  # some stores raise where others say no
        if "FileAlreadyExists" in str(e):
            return False
        raise
