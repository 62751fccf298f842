"""Selection, projection, aggregation, grouping and ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.primitives import positions


def point_selection(df: DataFrame, column: str, key) -> DataFrame:
    return df.where(F.col(column) == F.lit(key))


def range_selection(df: DataFrame, column: str, low, high) -> DataFrame:
    """Both ends count."""
    return df.where(F.col(column).between(low, high))


def selection(df: DataFrame, column: str, low, high) -> DataFrame:
    return point_selection(df, column, low) if low == high else range_selection(df, column, low, high)


def project(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)


def project_rids(base: DataFrame, rids: DataFrame, *columns: str, rid: str = "rid") -> DataFrame:
    """The rows of ``base`` that a list of row ids names, as often as it names them."""
    return rids.select(rid).join(base.select(rid, *columns), rid)


def rid_list(df: DataFrame, rid: str = "rid") -> DataFrame:
    return df.select(rid)


def compose_rids(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """(rid, value) lists: outer's value is a rid of inner; the result's value is inner's."""
    o, i = outer.alias("o"), inner.alias("i")
    return o.join(i, F.col("o.value") == F.col("i.rid")).select("o.rid", "i.value")


def int_avg(column: str | Column) -> Column:
    """Integer average, truncated toward zero; null if there is nothing."""
    c = F.col(column) if isinstance(column, str) else column
    return _div(F.sum(c.cast("long")), F.count(c))


def _div(a: Column, b: Column) -> Column:
    # sums and counts are whole: their truncated quotient without passing through doubles
    return F.when(b > 0, ((a - F.try_mod(a, b)) / b).cast("long"))


AGGREGATES = {
    "SUM": lambda c: F.sum(F.col(c).cast("long")),
    "MAX": F.max,
    "MIN": F.min,
    "AVG": int_avg,
    "COUNT": F.count,
}


def aggregate(df: DataFrame, op: str, column: str, alias: str | None = None) -> DataFrame:
    return df.agg(AGGREGATES[op](column).alias(alias or f"{op.lower()}_{column}"))


def group_aggregate(df: DataFrame, key: str, op: str, column: str, alias: str | None = None) -> DataFrame:
    return df.groupBy(key).agg(AGGREGATES[op](column).alias(alias or f"{op.lower()}_{column}"))


def group_positions(df: DataFrame, key: str) -> DataFrame:
    """(ordinal, key, start_pos, end_pos): where each group stands when rows are sorted by key. Runs
    on one row for each group."""
    groups = df.groupBy(key).agg(F.count("*").alias("n"))
    ordered = positions(groups, [key], also={"end_pos": "n"})
    return ordered.select(F.col("pos").alias("ordinal"), key, (F.col("end_pos") - F.col("n")).alias("start_pos"), "end_pos")


def group_ordinals(df: DataFrame, key: str, op: str, column: str, alias: str) -> DataFrame:
    """(ordinal, aggregate): groups by their place in ascending order of keys."""
    groups = group_aggregate(df, key, op, column, alias)
    return positions(groups, [key]).select(F.col("pos").alias("ordinal"), alias)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def order_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.orderBy(*keys)


def sort_within(df: DataFrame, segment: str, *columns: str | Column) -> DataFrame:
    """Each segment sorted on its own."""
    return df.repartition(segment).sortWithinPartitions(segment, *columns)


def order_positions(df: DataFrame, key: str | Column, rid: str) -> DataFrame:
    """Every row with its place in the order of a key (a column or an expression, ascending or not); ties by rid."""
    return positions(df, [key, rid])


def segment_ranks(df: DataFrame, segment: str, *columns: str | Column) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(segment).orderBy(*columns)) - 1)
