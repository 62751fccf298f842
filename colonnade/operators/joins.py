"""Joins. All are inner joins; the named algorithms are hints to the planner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.indexes import Index, sorted_scans

#: Fixed mapping of join algorithms to the planner's hints. An index join has no hint: the planner
#: broadcasts a side only if its size is below spark.sql.autoBroadcastJoinThreshold.
HINTS = {"nested": "shuffle_replicate_nl", "merge": "merge", "hash": "shuffle_hash", "index": None}


#: The nested loop compares all pairs: it is taken for sides whose sizes in bytes have at most this product.
NESTED_BYTES = 1 << 40


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def join(left: DataFrame, right: DataFrame, on: Column, algorithm: str | None = None) -> DataFrame:
    hint = HINTS[algorithm] if algorithm else None
    if algorithm == "nested" and estimated_bytes(left) * estimated_bytes(right) > NESTED_BYTES:
        hint = None
    return left.join(right.hint(hint) if hint else right, on)


def index_join(left: DataFrame, right: DataFrame, on: Column, most_bytes: int = 64 << 20) -> DataFrame:
    """``right`` is the indexed side. It goes to every executor only if the optimizer's size estimate
    is within ``most_bytes``; else both sides are sorted and merged."""
    return left.join(F.broadcast(right) if estimated_bytes(right) <= most_bytes else right.hint("merge"), on)


def presorted_merge_join(spark: SparkSession, left: Index, right: Index) -> DataFrame:
    """Two indexes with as many buckets are merged as they are: nothing is shuffled or sorted."""
    if left.buckets != right.buckets:
        raise ValueError("the indexes have different numbers of buckets")
    with sorted_scans(spark):
        joined = left.table(spark).join(right.table(spark).hint("merge"), F.col(left.column) == F.col(right.column))
        joined._jdf.queryExecution().executedPlan()  # the plan is made while scans count as sorted
    return joined


def join_pairs(left: DataFrame, right: DataFrame, left_rid: str, right_rid: str, on: Column, algorithm: str | None = None) -> DataFrame:
    return join(left, right, on, algorithm).select(F.col(left_rid).alias("r_rid"), F.col(right_rid).alias("s_rid"))


def theta_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Any comparison. Filter both sides first: the result itself grows with their product."""
    return left.join(right, on)


def band_join(left: DataFrame, right: DataFrame, a: str, b: str, width: int) -> DataFrame:
    """abs(a - b) <= width, as an equality join on cells: a row of the right is in three cells, and
    the distance is checked in each. A pair meets in one cell only."""
    w = max(width, 1)
    l = left.withColumn("__cell", F.floor(F.col(a) / w))  # noqa: E741
    near = F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.floor(F.col(b) / w) + i))
    r = right.withColumn("__cell", near)
    return l.join(r, "__cell").where(F.abs(F.col(a) - F.col(b)) <= width).drop("__cell")


def _level(low: str, high: str) -> Column:
    """The least k such that cells of 2**k are longer than the interval's length."""
    d = F.col(high).cast("long") - F.col(low).cast("long")
    return F.when(d == 0, 0).otherwise(F.length(F.bin(d)))


def overlap_join(left: DataFrame, right: DataFrame, l_low: str, l_high: str, r_low: str, r_high: str) -> DataFrame:
    """Closed intervals that share a point. Cells of a level have 2**level points, an interval's own level has
    cells longer than itself, so it touches two of them at most, however long it is. Two intervals meet in
    the cells of the higher of their levels: each goes to its own level and to those above that the other
    side has. A pair is kept in the cell of the later beginning only, so nothing has to be made distinct.
    Empty intervals match nothing."""
    l = left.where(F.col(l_low) <= F.col(l_high))  # noqa: E741
    r = right.where(F.col(r_low) <= F.col(r_high))
    # the levels of each side: 64 numbers at most
    levels = l.select(F.lit(0).alias("side"), _level(l_low, l_high).alias("level")).union(r.select(F.lit(1), _level(r_low, r_high))).distinct().collect()
    of_left, of_right = (sorted(x.level for x in levels if x.side == k) for k in (0, 1))

    def placed(df: DataFrame, low: str, high: str, others: list[int], own: str) -> DataFrame:
        df = df.withColumn(own, _level(low, high))
        above = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > F.col(own))
        df = df.withColumn("__level", F.explode(F.concat(F.array(F.col(own)), above)))
        cell = lambda c: F.expr(f"shiftright(cast(`{c}` as bigint), __level)")
        return df.withColumn("__cell", F.explode(F.sequence(cell(low), cell(high))))

    pairs = placed(l, l_low, l_high, of_right, "__own_l").join(placed(r, r_low, r_high, of_left, "__own_r"), ["__level", "__cell"])
    meets = (F.col(l_low) <= F.col(r_high)) & (F.col(r_low) <= F.col(l_high))
    once = (F.greatest("__own_l", "__own_r") == F.col("__level")) & (F.expr(f"shiftright(cast(greatest(`{l_low}`, `{r_low}`) as bigint), __level)") == F.col("__cell"))
    return pairs.where(meets & once).drop("__level", "__cell", "__own_l", "__own_r")
