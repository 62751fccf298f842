"""Map, scatter, gather, reduce, scan, split, partition, quantiles, lower bounds, string order.

Whatever needs a total order deals rows out into as many ranges of it as there are shuffle partitions, and
writes them once, each range as one sorted file. A row's place in its range is then its place in its file; rows
are counted or summed by range, and each range starts from the sum of those before it. So no step brings
all rows to one task; a window without partitions runs over one row for each range only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: What rows are ordered by: names of columns, or expressions (descending ones too).
Order = list[str | Column]


def positions(df: DataFrame, order: Order, also: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``pos``, a row's place (from 0) in the order; and for each of ``also`` (name:
    column) the sum of the column up to and with the row. Rows equal in ``order`` get places in no
    given order. The rows are written to the shared folder and their scan is what is returned."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges").withColumn("__row", F.col("_metadata.row_index"))
    sums = {"__n": F.count("*"), **{f"__{k}": F.sum(v) for k, v in (also or {}).items()}}
    by_range = ranged.groupBy("__range").agg(*(v.alias(k) for k, v in sums.items()))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.select("__range", *(F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(k) for k in sums))
    # one row for each shuffle partition at most
    out = ranged.join(F.broadcast(starts), "__range").withColumn("pos", F.col("__row") + F.col("__n"))
    upto = Window.partitionBy("__range").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    for k, v in (also or {}).items():
        out = out.withColumn(k, F.sum(v).over(upto) + F.col(f"__{k}"))
    return out.drop("__range", "__row", *sums)


def map_(df: DataFrame, f: Callable[..., Column], *columns: str, alias: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """f(columns) of each row, as an expression."""
    return df.select(*keep, f(*map(F.col, columns)).alias(alias))


def scatter(df: DataFrame, loc: str, value: str, rid: str = "rid") -> DataFrame:
    """(pos, value): S[loc] = R. Of rows that go to one place, the one with the greatest rid is there."""
    return df.groupBy(F.col(loc).alias("pos")).agg(F.max_by(value, rid).alias(value))


def gather(source: DataFrame, places: DataFrame, loc: str, rid: str = "rid") -> DataFrame:
    """For each row of ``places``, the row of ``source`` whose rid is its loc."""
    return places.join(source, places[loc] == source[rid])


def reduce_(df: DataFrame, *aggregates: Column) -> DataFrame:
    """Partial results by task, then one."""
    return df.agg(*aggregates)


def exclusive_scan(df: DataFrame, rid: str, value: str, alias: str = "scan") -> DataFrame:
    """The sum of all values before a row."""
    return positions(df, [rid], also={alias: value}).withColumn(alias, F.col(alias) - F.col(value)).drop("pos")


def split(df: DataFrame, part: Column, rid: str) -> DataFrame:
    """Rows in the order of partitions, those of a partition in the order of rids: ``part`` and ``pos``."""
    return positions(df.withColumn("part", part), ["part", rid])


def split_starts(df: DataFrame, part: Column) -> DataFrame:
    """(part, start_pos, n) of the partitions that have rows."""
    counts = df.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    return positions(counts, ["part"], also={"end": "n"}).select("part", (F.col("end") - F.col("n")).alias("start_pos"), "n")


def quantile_positions(df: DataFrame, column: str, n: int) -> DataFrame:
    """(quantile, pos, value): places k * rows / n of the ascending order, each moved to the first row
    with the same value. Values are counted and put in order; each finds the quantiles among its rows."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    placed = positions(counts, ["value"], also={"end": "n"}).withColumn("begin", F.col("end") - F.col("n"))
    rows = placed.agg(F.max("end").alias("rows"))
    # floor(k * rows / n) is at least begin and below end
    least = lambda at: F.expr(f"({at} * {n} + rows - 1) div rows")
    found = placed.crossJoin(F.broadcast(rows)).withColumns({"low": least("begin"), "high": least("end") - 1})
    found = found.where(f"low <= high and low < {n}").withColumn("quantile", F.explode(F.sequence("low", F.least("high", F.lit(n - 1)))))
    return found.select(F.col("quantile").cast("int").alias("quantile"), F.col("begin").alias("pos"), "value")


def interval_bounds(df: DataFrame, column: str, rid: str, size: int) -> DataFrame:
    """(interval, min_value, max_value): least and greatest value plus one of each ``size`` rows in order."""
    placed = positions(df.select(column, rid), [column, rid]).withColumn("interval", F.floor(F.col("pos") / size))
    return placed.groupBy("interval").agg(F.min(column).alias("min_value"), (F.max(column) + 1).alias("max_value"))


def lower_bound(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """(key, pos, found): how many values are below each key, and whether it occurs. Values and keys
    are placed in one order, so no pairs are made."""
    values = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).withColumn("k", F.lit(0))
    asked = keys.select(F.col(key).alias("v")).distinct().withColumn("n", F.lit(0).cast("long")).withColumn("k", F.lit(1))
    both = values.unionByName(asked).groupBy("v").agg(F.sum("n").alias("n"), F.max("k").alias("k"))
    placed = positions(both, ["v"], also={"end": "n"})
    return placed.where("k = 1").select(F.col("v").alias(key), (F.col("end") - F.col("n")).alias("pos"), (F.col("n") > 0).alias("found"))


def string_sort(df: DataFrame, key: str, rid: str) -> DataFrame:
    """Rows with their places in bytewise order of keys."""
    return positions(df, [key, rid])


def string_key_ranges(df: DataFrame, key: str) -> DataFrame:
    """(key, start_pos, end_pos) of each distinct key in bytewise order."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return positions(counts, [key], also={"end_pos": "n"}).select(key, (F.col("end_pos") - F.col("n")).alias("start_pos"), "end_pos")
