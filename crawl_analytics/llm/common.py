"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import os
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_run_dir

ARROW_ROWS = 1000
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(rows: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and computes a shared step once."""
    spark = rows.sparkSession
    path = new_run_dir(spark, name)
    rows.write.option("compression", codec).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers a thousand at a time: a worker holds a few megabytes of them, not 64."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def unused(rows: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``rows`` is called so."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def share(*keys: str | Column, seed: int = 0) -> Column:
    """A number in [0, 1) from a hash of ``keys``: the same for a row in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / F.lit(float(1 << 40))


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, math.ceil(rows / per_block))


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, made through Spark's own file system."""
    path = new_run_dir(spark, name)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(hadoop)
    return system.makeQualified(hadoop).toString()


def file_system(uri: str):
    """(pyarrow file system, path on it) of a shared folder: file, hdfs, s3, gs, abfs."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file" or "/" in scheme or not rest:
        path = rest if scheme == "file" else uri
        return fs.LocalFileSystem(), "/" + path.lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


@contextmanager
def whole_file(uri: str, attempt: str):
    """An output stream whose file gets its name only when it is complete.

    A task that is run again writes the same bytes under the same name, so neither a
    lost executor nor a speculative copy leaves half a file behind.
    """
    system, path = file_system(uri)
    partial = f"{path}.{attempt}.partial"
    with system.open_output_stream(partial) as out:
        yield out
    system.move(partial, path)


def attempt_name() -> str:
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{os.getpid()}-{context.taskAttemptId() if context else 0}"


def binary_texts(batch, column: str) -> list[bytes]:
    """The column's texts as UTF-8, None as empty."""
    return [t or b"" for t in batch.column(column).to_pylist()]
