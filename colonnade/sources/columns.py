"""Text files: one column as ``rid value`` lines, and rows as numbers with spaces between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.primitives import positions


def read_column(spark: SparkSession, path: str) -> DataFrame:
    """(rid, value). Lines with one number, the counts at the head, are skipped."""
    df = spark.read.csv(path, sep=" ", schema="rid long, value int")
    return df.where("value is not null")


def write_column(df: DataFrame, path: str) -> None:
    df.select("rid", "value").write.mode("overwrite").csv(path, sep=" ")


def read_rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Lines of integers -> rid (the line's place, from 0; lines of several files in the order of their names)
    and a column for each number. Negative numbers are refused when the file is read, as is a line without enough
    numbers; empty lines do not count."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    n, df = len(names), lines.where(F.trim("value") != "")
    parts = F.split(F.trim("value"), r"\s+")
    bad = (F.size(parts) != n) | F.exists(parts, lambda x: x.try_cast("int").isNull() | (x.try_cast("int") < 0))
    df = df.withColumn("parts", F.when(bad, F.raise_error(F.concat(F.lit("not a row of this table: "), "value"))).otherwise(parts))
    # a text scan keeps the order of lines within a block, and ids grow with it
    df = df.select("file_path", "file_block_start", F.monotonically_increasing_id().alias("__at"), *(F.col("parts")[i].cast("int").alias(c) for i, c in enumerate(names)))
    placed = positions(df, ["file_path", "file_block_start", "__at"])
    return placed.select(F.col("pos").alias("rid"), *names)


def write_rows(df: DataFrame, path: str, names: list[str]) -> None:
    df.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in names)).alias("value")).write.mode("overwrite").text(path)
