"""Shared folder and session settings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def use_utc(spark: SparkSession) -> None:
    """Zone-less timestamps are read as UTC; set before a plan is analysed."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@contextmanager
def open_writers(spark: SparkSession, files: int) -> Iterator[None]:
    """Partitioned writes inside keep up to ``files`` files open per task, a partition each, instead of sorting all rows; with 0 they sort.

    Rows of further partitions are sorted still. A setting made outside stands.
    """
    name = "spark.sql.maxConcurrentOutputFileWriters"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, files)
    try:
        yield
    finally:
        spark.conf.unset(name)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    A folder of this machine is only taken in local mode, where there is no other machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="crawl-analytics-"))
    return sc.getCheckpointDir()


def new_run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
