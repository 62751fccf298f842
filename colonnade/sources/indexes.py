"""Index objects: copies of a table, dealt out by a key into buckets and sorted in each, in the session's catalog.

What is looked up by the key reads one bucket, and two tables with as many buckets are merged as they
are, without shuffling or sorting them again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .scratch import discard, scratch

#: Lets a scan of a bucket that is one sorted file tell the planner so.
_SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@dataclass(frozen=True)
class Index:
    name: str  # in the catalog
    column: str
    buckets: int
    folder: str

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)


def build_index(df: DataFrame, column: str, buckets: int, name: str | None = None) -> Index:
    """Each bucket is written by one task, as one sorted file."""
    name = name or f"index_{uuid.uuid4().hex}"
    folder = scratch(df.sparkSession, name)
    rows = df.repartition(buckets, column)
    rows.write.mode("overwrite").option("path", folder).bucketBy(buckets, column).sortBy(column).format("parquet").saveAsTable(name)
    return Index(name, column, buckets, folder)


def drop_index(spark: SparkSession, index: Index) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {index.name}")
    discard(spark, index.folder)


def has_index(spark: SparkSession, index: Index) -> bool:
    return spark.catalog.tableExists(index.name)


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Plans that are made inside take sorted buckets as sorted."""
    before = spark.conf.get(_SORTED_SCANS, None)
    spark.conf.set(_SORTED_SCANS, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SORTED_SCANS) if before is None else spark.conf.set(_SORTED_SCANS, before)
