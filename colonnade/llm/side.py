"""Tables that tasks look up by the input file they read, instead of shuffling that file's texts.

A table with columns ``_f`` and ``_r`` (a row's file and place, see ``common.keyed``) is written below the
shared folder, partitioned by ``_f``; a task that reads a file reads the rows of that file only. A file of very
many rows is written by several tasks, each with a stretch of its rows.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that Spark named, and the path in it."""
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


#: Rows of a file that one task writes about.
STRETCH = 1 << 16


def put(df: DataFrame, name: str) -> str:
    """Write a table for lookups; returns its folder."""
    path = scratch(df.sparkSession, name)
    rows = df.repartition(F.col("_f"), F.floor(F.col("_r") / STRETCH)).sortWithinPartitions("_f", "_r").withColumn("file", F.col("_f"))
    rows.drop("_f").write.mode("overwrite").partitionBy("file").parquet(path)
    return path


@lru_cache(maxsize=256)
def _dataset(folder: str, file: int) -> ds.Dataset | None:
    """Found once for each worker: what ``put`` has written does not change."""
    system, root = store(folder)
    path = f"{root}/file={file}"
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return None
    return ds.dataset(path, filesystem=system, format="parquet", exclude_invalid_files=False)


def get(folder: str, file: int, columns: list[str], low: int, high: int) -> pa.Table:
    """The rows of one file with low <= _r <= high."""
    found = _dataset(folder, file)
    if found is None:
        return pa.table({c: [] for c in columns})
    return found.to_table(columns=columns, filter=(ds.field("_r") >= low) & (ds.field("_r") <= high))
