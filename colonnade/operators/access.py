"""Lookups by key: hash buckets and ordered search, as joins and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.primitives import positions
from ..sources.indexes import Index, sorted_scans


def bucket(value: Column, n: int | Column) -> Column:
    """Of a table of n rows: the value without its lowest bit, over half of n (a power of two at most n)."""
    if isinstance(n, int):
        size = F.lit(max(1, (1 << (max(n, 1).bit_length() - 1)) >> 1))
    else:  # known when the query runs
        size = F.greatest(F.lit(1), F.shiftright(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n)) - 1), 1)).cast("int")
    return F.shiftright(value, 1).bitwiseAND(size - 1)


def hash_bounds(df: DataFrame, column: str, n: int | Column) -> DataFrame:
    """(bucket, start_pos, end_pos): rows stand in the order of buckets, so each bucket is one run."""
    counts = df.groupBy(bucket(F.col(column), n).alias("bucket")).agg(F.count("*").alias("n"))
    ends = positions(counts, ["bucket"], also={"end_pos": "n"})
    return ends.select("bucket", (F.col("end_pos") - F.col("n")).alias("start_pos"), "end_pos")


def hash_search(df: DataFrame, probes: DataFrame, column: str, probe: str, n: int | Column) -> DataFrame:
    """Rows and probes that are equal: they meet in a bucket and are compared there."""
    l = df.withColumn("__b", bucket(F.col(column), n))  # noqa: E741
    r = probes.withColumn("__b", bucket(F.col(probe), n))
    same = (l["__b"] == r["__b"]) & (F.col(column) == F.col(probe))
    return l.join(r, same).drop("__b")


def bucket_fetch(df: DataFrame, probes: DataFrame, column: str, probe: str, n: int | Column) -> DataFrame:
    """All rows of each probe's bucket, equal or not."""
    l = df.withColumn("__b", bucket(F.col(column), n))  # noqa: E741
    r = probes.withColumn("__b", bucket(F.col(probe), n))
    return l.join(r, "__b").drop("__b")


def key_search(df: DataFrame, column: str, key) -> DataFrame:
    return df.where(F.col(column) == F.lit(key))


def key_search_many(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Matching rows, once for each equal key in the list."""
    return df.join(keys.select(F.col(key).alias("__k")), F.col(column) == F.col("__k")).drop("__k")


def tree_search(df: DataFrame, probes: DataFrame, column: str, probe: str) -> DataFrame:
    return df.join(probes, F.col(column) == F.col(probe))


def index_search(spark: SparkSession, index: Index, keys: DataFrame, key: str) -> DataFrame:
    """Matching rows of an index, once for each equal key: keys go to their buckets, the index is read as it is."""
    keys = keys.select(F.col(key).alias("__k")).repartition(index.buckets, "__k")
    with sorted_scans(spark):
        found = index.table(spark).join(keys.hint("merge"), F.col(index.column) == F.col("__k")).drop("__k")
        found._jdf.queryExecution().executedPlan()  # the plan is made while scans count as sorted
    return found
