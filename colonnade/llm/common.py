"""What the corpus operators share: scratch tables in the shared folder and row keys."""

from __future__ import annotations

import ctypes
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialize, scratch, shared_dir  # noqa: F401

#: White space and its complement as the corpus contracts define them (not Unicode's).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _located(docs: DataFrame) -> bool:
    """Whether every row of ``docs`` has a file and a place in it (no column of its own may hide them)."""
    if "_metadata" in (c.lower() for c in docs.columns):
        return False
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        return True
    except AnalysisException:
        return False


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` as a file scan whose rows have keys. A frame that is no plain file scan, or has a column
    named ``_metadata``, is written to the shared folder first, once for each frame."""
    if _located(docs):
        return docs
    if "_written" not in vars(docs):
        new = next(n for n in (f"__hidden{i}" for i in itertools.count()) if n not in docs.columns)
        renamed = {c: f"{new}_{i}" for i, c in enumerate(docs.columns) if c.lower() == "_metadata"}
        docs._written = materialize(docs.withColumnsRenamed(renamed), "rows")
        docs._written._first_names = {n: c for c, n in renamed.items()}
    return docs._written


def keyed(docs: DataFrame, *cols: Column | str) -> DataFrame:
    """``cols`` with a key of the physical row: ``_f`` (file) and ``_r`` (row in the file).

    Unlike ``doc_id`` it is never null and never repeats, and it is the same in every scan.
    """
    key = [F.xxhash64(F.col("_metadata.file_path")).alias("_f"), F.col("_metadata.row_index").alias("_r")]
    return scanned(docs).select(*key, *cols)


def with_keys(docs: DataFrame) -> DataFrame:
    """``_f``, ``_r`` and ``row``, a struct of all columns of ``docs`` by their names."""
    names = vars(scanned(docs)).get("_first_names", {})
    return keyed(docs, F.struct(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in scanned(docs).columns)).alias("row"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: int, rows: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch of so many rows at most and, but for single rows, so many bytes of text in a column."""
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0)), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        begin = int(ends[at - 1]) if at else 0
        to = max(at + 1, min(at + rows, int(np.searchsorted(ends, begin + size, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def release() -> None:
    """Give memory that is no longer used back to the machine, as far as allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


#: Bytes of an Arrow batch between the JVM and Python workers, at most: both hold some of them at a time.
BATCH_BYTES = 8 << 20


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` by a frugal function. Lowers the session's bound on batches, which counts when the plan
    is run, to ``BATCH_BYTES``, if it is higher."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.match(r"(-?\d+)b?$", conf.get(key))
    if now is None or not 0 < int(now[1]) <= BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return df.mapInArrow(frugal(run), schema)


def frugal(run: Callable) -> Callable:
    """A function for mapInArrow that releases memory batch by batch: Python workers live on from task to task,
    and several share an executor with its JVM."""

    def wrapped(batches):
        def each():
            for batch in batches:
                yield batch
                release()

        yield from run(each())
        release()

    return wrapped
