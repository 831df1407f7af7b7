"""Columns and types of Parquet files, read from their footers by a Spark job."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_run_dir


def groups_by_schema(
    spark: SparkSession, paths: list[str], frames_of: Callable, skip: set[str] = frozenset()
) -> list[tuple[dict[str, str], list[str]]]:
    """[({column: Spark type}, [file])] of the Parquet files below ``paths``, one entry per set of columns and types.

    Spark lists the files; tasks read the footers, nothing else. Columns that hold NULL only have no type and are left out. With one
    group no path is returned: it is everything. Else a folder whose files are of one group stands for them, and only
    files of mixed folders are named.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    found = frames_of(reader.load, paths)
    if not found:
        return []
    skipped = set(skip)

    def footers(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq
        import pyarrow.types as kinds
        from pyarrow import fs

        plain = [
            (kinds.is_boolean, "boolean"),
            (lambda t: kinds.is_int8(t) or kinds.is_int16(t) or kinds.is_int32(t), "int"),
            (kinds.is_integer, "bigint"),
            (kinds.is_float32, "float"),
            (kinds.is_float64, "double"),
            (lambda t: kinds.is_string(t) or kinds.is_large_string(t), "string"),
            (lambda t: kinds.is_binary(t) or kinds.is_large_binary(t), "binary"),
            (kinds.is_date32, "date"),
            (lambda t: kinds.is_timestamp(t) and t.tz is not None, "timestamp"),
            (kinds.is_timestamp, "timestamp_ntz"),
        ]

        def spark_type(t) -> str | None:
            for fits, name in plain:
                if fits(t):
                    return name
            if kinds.is_decimal(t):
                return f"decimal({t.precision},{t.scale})"
            if kinds.is_struct(t):
                inner = [(f.name, spark_type(f.type)) for f in t]
                known = ", ".join(f"`{n}`: {k}" for n, k in inner if k)
                return f"struct<{known}>" if known else None
            if kinds.is_map(t):
                key, value = spark_type(t.key_type), spark_type(t.item_type)
                return f"map<{key}, {value}>" if key and value else None
            if kinds.is_list(t) or kinds.is_large_list(t):
                inner = spark_type(t.value_type)
                return f"array<{inner}>" if inner else None
            return None

        for batch in batches:
            names = batch.column("path").to_pylist()
            shapes = []
            for name in names:
                if name.startswith("file:"):
                    system, path = fs.LocalFileSystem(), "/" + name.removeprefix("file:").lstrip("/")
                else:
                    system, path = fs.FileSystem.from_uri(name.replace("s3a://", "s3://", 1))
                with system.open_input_file(path) as file:
                    columns = [(f.name, spark_type(f.type)) for f in pq.read_schema(file)]
                shapes.append(json.dumps([c for c in columns if c[1] and c[0] not in skipped]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(shapes, pa.string())], names=["path", "shape"])

    files = reduce(DataFrame.unionByName, [rows.select("path") for rows in found])
    path = new_run_dir(spark, "file-shapes")
    files.mapInArrow(footers, "path string, shape string").write.parquet(path)
    shapes = spark.read.schema("path string, shape string").parquet(path).withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    kinds = [r["shape"] for r in shapes.select("shape").distinct().collect()]
    if len(kinds) == 1:
        return [(dict(json.loads(kinds[0])), [])]
    folders = shapes.groupBy("folder").agg(F.min("shape").alias("shape"), F.max("shape").alias("other"))
    whole = folders.where("shape = other").select("shape", F.col("folder").alias("path"))
    single = shapes.join(folders.where("shape != other").select("folder"), "folder", "left_semi").select("shape", "path")
    named: dict[str, list[str]] = {}
    for row in whole.unionByName(single).orderBy("shape", "path").collect():
        named.setdefault(row["shape"], []).append(row["path"])
    return [(dict(json.loads(shape)), paths) for shape, paths in named.items()]
