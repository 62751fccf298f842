import random

import pytest
from pyspark.sql import functions as F

from colonnade.functions import fields as FL
from colonnade.functions import hashing as H
from colonnade.functions import primitives as P
from colonnade.operators import access as A
from colonnade.operators import joins as J
from colonnade.operators import relational as O
from colonnade.sources.indexes import build_index, drop_index, has_index

CASES = {
    "empty": [],
    "one": [7],
    "equal": [3] * 20,
    "negative": [-5, 4, -5, 0, 2, -9],
    "large": [1 << 30, (1 << 31) - 1, 5, (1 << 31) - 1],
    "random": [random.Random(1).randrange(50) for _ in range(200)],
}


@pytest.fixture(scope="module", params=sorted(CASES))
def table(request, spark):
    v = CASES[request.param]
    return v, spark.createDataFrame(list(enumerate(v)), "rid long, value int").repartition(3)


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


def test_selection(table):
    v, df = table
    assert tuples(O.selection(df, "value", 3, 3)) == [(i, x) for i, x in enumerate(v) if x == 3]
    assert tuples(O.selection(df, "value", -5, 4)) == [(i, x) for i, x in enumerate(v) if -5 <= x <= 4]


def test_aggregates(table):
    v, df = table
    want = {"SUM": sum(v), "MAX": max(v), "MIN": min(v), "AVG": int(sum(v) / len(v)), "COUNT": len(v)} if v else dict.fromkeys(["SUM", "MAX", "MIN", "AVG"]) | {"COUNT": 0}
    for op, x in want.items():
        assert O.aggregate(df, op, "value", "v").collect()[0].v == x, op


def test_average_truncates_toward_zero(spark):
    df = spark.createDataFrame([(-3,), (-4,)], "value int")
    assert O.aggregate(df, "AVG", "value", "v").collect()[0].v == -3


def test_groups(table):
    v, df = table
    keys = sorted({x % 7 for x in v})
    df = df.withColumn("k", F.pmod("value", F.lit(7)))
    assert tuples(O.group_aggregate(df, "k", "SUM", "value", "s")) == [(k, sum(x for x in v if x % 7 == k)) for k in keys]
    want, at = [], 0
    for i, k in enumerate(keys):
        n = sum(x % 7 == k for x in v)
        want.append((i, k, at, at + n))
        at += n
    assert tuples(O.group_positions(df, "k")) == want
    assert tuples(O.group_ordinals(df, "k", "MAX", "value", "m")) == [(i, max(x for x in v if x % 7 == k)) for i, k in enumerate(keys)]


def test_positions_and_scan(table):
    v, df = table
    order = sorted(range(len(v)), key=lambda i: (v[i], i))
    assert tuples(O.order_positions(df, "value", "rid").select("pos", "rid")) == list(enumerate(order))
    assert tuples(P.exclusive_scan(df, "rid", "value").select("rid", "scan")) == [(i, sum(v[:i])) for i in range(len(v))]


def test_split(table):
    v, df = table
    part = H.mod_part(F.col("value"), 4)
    order = sorted(range(len(v)), key=lambda i: (v[i] % 4, i))
    assert tuples(P.split(df, part, "rid").select("pos", "rid")) == list(enumerate(order))
    starts, at = [], 0
    for p in range(4):
        n = sum(x % 4 == p for x in v)
        if n:
            starts.append((p, at, n))
        at += n
    assert tuples(P.split_starts(df, part)) == starts


def test_rs_partition(spark):
    def rs(v, n):
        h, a = 0, 63689
        for i in range(4):
            h = (h * a + (v >> (24 - 8 * i))) & 0xFFFFFFFF
            a = a * 378551 & 0xFFFFFFFF
        return h & (n - 1)

    v = [0, 1, 63, 255, 256, 99_999, (1 << 30) - 1, 123_456_789]
    df = spark.createDataFrame([(x,) for x in v], "value int")
    for n in (2, 64, 1024):
        assert [r.p for r in df.select(H.rs_part(F.col("value"), n).alias("p")).collect()] == [rs(x, n) for x in v]
    with pytest.raises(ValueError):
        H.rs_part(F.col("value"), 6)


def test_scatter_gather(table, spark):
    v, df = table
    n = len(v)
    perm = list(range(n))
    random.Random(2).shuffle(perm)
    loc = spark.createDataFrame(list(enumerate(perm)), "rid long, loc long")
    moved = df.join(loc, "rid")
    assert tuples(P.scatter(moved, "loc", "value")) == sorted((perm[i], v[i]) for i in range(n))
    got = P.gather(df.select(F.col("rid").alias("src"), "value"), loc, "loc", "src")
    assert tuples(got.select(F.col("rid"), "value")) == [(i, v[perm[i]]) for i in range(n)]


def test_scatter_collision(spark):
    df = spark.createDataFrame([(0, 5, 1), (1, 6, 1), (2, 7, 0)], "rid long, value int, loc long")
    assert tuples(P.scatter(df, "loc", "value")) == [(0, 7), (1, 6)]


def test_quantiles_and_bounds(table, spark):
    v, df = table
    s = sorted(v)
    want = [(k, s.index(s[k * len(s) // 4]), s[k * len(s) // 4]) for k in range(4)] if s else []
    assert tuples(P.quantile_positions(df, "value", 4)) == want
    keys = spark.createDataFrame([(x,) for x in (-100, 3, 4, 49, 1 << 30)], "k int")
    assert tuples(P.lower_bound(df, "value", keys, "k")) == [(k, sum(x < k for x in v), k in v) for k in (-100, 3, 4, 49, 1 << 30)]
    bounds = [(i // 8, s[i], s[min(i + 8, len(s)) - 1] + 1) for i in range(0, len(s), 8)] if s and max(s) < (1 << 31) - 1 else None
    if bounds is not None:
        assert tuples(P.interval_bounds(df, "value", "rid", 8)) == bounds


def test_strings(spark):
    keys = ["b", "ab", "a", "", "ab", "B", "abc", "é"]
    df = spark.createDataFrame(list(enumerate(keys)), "rid long, key string")
    order = sorted(range(len(keys)), key=lambda i: (keys[i].encode(), i))
    assert tuples(P.string_sort(df, "key", "rid").select("pos", "rid")) == list(enumerate(order))
    s = sorted(k.encode() for k in keys)
    want = sorted((k.decode(), s.index(k), s.index(k) + s.count(k)) for k in set(s))
    assert tuples(P.string_key_ranges(df, "key")) == want


def test_join_algorithms(table, spark):
    v, df = table
    s = spark.createDataFrame([(i, x) for i, x in enumerate([3, 3, 7, -5, (1 << 31) - 1, 1000])], "sid long, w int")
    on = F.col("value") == F.col("w")
    want = sorted((i, j) for i, x in enumerate(v) for j, y in enumerate([3, 3, 7, -5, (1 << 31) - 1, 1000]) if x == y)
    for a in J.HINTS:
        assert tuples(J.join_pairs(df, s, "rid", "sid", on, a)) == want, a
    assert tuples(J.index_join(df, s, on).select("rid", "sid")) == want
    assert tuples(J.index_join(df, s, on, most_bytes=0).select("rid", "sid")) == want
    sides = build_index(df, "value", 3), build_index(s, "w", 3)
    assert tuples(J.presorted_merge_join(spark, *sides).select("rid", "sid")) == want
    assert tuples(A.index_search(spark, sides[0], s, "w").select("rid")) == [(i,) for i, _ in want]
    for x in sides:
        drop_index(spark, x)
        assert not has_index(spark, x)
    assert tuples(A.tree_search(df, s, "value", "w").select("rid", "sid")) == want
    assert tuples(A.hash_search(df, s, "value", "w", len(v)).select("rid", "sid")) == want


def test_hints_reach_the_plan(spark):
    a, b = spark.range(100).toDF("a"), spark.range(100).toDF("b")
    for algorithm, node in (("hash", "ShuffledHashJoin"), ("merge", "SortMergeJoin"), ("nested", "CartesianProduct")):
        plan = J.join(a, b, F.col("a") == F.col("b"), algorithm)._jdf.queryExecution().executedPlan().toString()
        assert node in plan
    assert "BroadcastHashJoin" in J.index_join(a, b, F.col("a") == F.col("b"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in J.index_join(a, b, F.col("a") == F.col("b"), 1)._jdf.queryExecution().executedPlan().toString()


def test_band_and_theta(table, spark):
    v, df = table
    w = [-7, 0, 4, 10, 49]
    s = spark.createDataFrame(list(enumerate(w)), "sid long, w int")
    for width in (0, 1, 5):
        want = sorted((i, j) for i, x in enumerate(v) for j, y in enumerate(w) if abs(x - y) <= width)
        assert tuples(J.band_join(df.withColumn("value", F.col("value").cast("long")), s, "value", "w", width).select("rid", "sid")) == want
    want = sorted((i, j) for i, x in enumerate(v) for j, y in enumerate(w) if x < y)
    assert tuples(J.theta_join(df, s, F.col("value") < F.col("w")).select("rid", "sid")) == want


def test_overlap(spark):
    g = random.Random(3)
    r = [(i, a, a + g.randrange(-2, 40)) for i, a in enumerate(g.randrange(-100, 300) for _ in range(60))]
    s = [(i, a, a + g.randrange(-2, 200)) for i, a in enumerate(g.randrange(-100, 300) for _ in range(40))]
    R, S = spark.createDataFrame(r, "rid long, a long, b long"), spark.createDataFrame(s, "sid long, c long, d long")
    want = sorted((i, j) for i, a, b in r for j, c, d in s if a <= b and c <= d and a <= d and c <= b)
    assert tuples(J.overlap_join(R, S, "a", "b", "c", "d").select("rid", "sid")) == want


def test_overlap_of_very_long_intervals(spark):
    """An interval over the whole domain is in two cells of its own level."""
    r = [(0, 0, 1 << 30), (1, -(1 << 31), (1 << 31) - 1), (2, 5, 5), (3, 77, 78), (4, (1 << 30) - 1, 1 << 30)]
    s = [(i, 7 * i, 7 * i + i % 3) for i in range(200)] + [(500, -(1 << 31), (1 << 31) - 1), (501, 1 << 30, 1 << 30)]
    R, S = spark.createDataFrame(r, "rid long, a int, b int"), spark.createDataFrame(s, "sid long, c int, d int")
    want = sorted((i, j) for i, a, b in r for j, c, d in s if a <= d and c <= b)
    assert tuples(J.overlap_join(R, S, "a", "b", "c", "d").select("rid", "sid")) == want
    assert tuples(J.overlap_join(S, R, "c", "d", "a", "b").select("rid", "sid")) == want
    assert J.overlap_join(R.limit(0), S, "a", "b", "c", "d").count() == 0


def test_merge_of_indexes_shuffles_and_sorts_nothing(spark):
    a, b = spark.range(1000).selectExpr("id as a", "id % 7 as v"), spark.range(500).selectExpr("id * 2 as b")
    sides = build_index(a, "a", 4), build_index(b, "b", 4)
    joined = J.presorted_merge_join(spark, *sides)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert joined.count() == 500
    plan = A.index_search(spark, sides[0], b, "b")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1
    with pytest.raises(ValueError):
        J.presorted_merge_join(spark, sides[0], build_index(b, "b", 5))


def test_keys_that_are_expressions(table):
    v, df = table
    want = sorted(range(len(v)), key=lambda i: (-(v[i] % 5), i))
    assert tuples(O.order_positions(df, F.pmod("value", F.lit(5)).desc(), "rid").select("pos", "rid")) == list(enumerate(want))
    assert tuples(P.split(df, F.pmod("value", F.lit(3)), "rid").select("part", "rid")) == sorted((x % 3, i) for i, x in enumerate(v))


def test_plans_do_not_grow_with_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        placed = P.positions(spark.range(2000).toDF("id"), ["id"])
        assert len(placed._jdf.queryExecution().optimizedPlan().toString()) < 10_000
        assert placed.where("id <> pos").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pivots_and_fields(spark):
    df = spark.range(50).withColumn("v", (F.col("id") - 10).cast("int"))
    for pivots in ([], [5], [0, 1, 2, 20], list(range(-5, 30, 3))):
        assert [r.p for r in df.select("id", H.pivot_part(F.col("v"), pivots).alias("p")).orderBy("id").collect()] == [sum(x <= i - 10 for x in pivots) for i in range(50)]
    with pytest.raises(ValueError):
        H.pivot_part(F.col("v"), list(range(2000)))
    with pytest.raises(ValueError):
        FL.put_fields(F.col("r"), {"q": F.lit(1)})


def test_nested_loop_for_small_sides_only(spark):
    a, b = spark.range(1 << 22).toDF("a"), spark.range(1 << 22).toDF("b")
    assert "CartesianProduct" not in J.join(a, b, F.col("a") == F.col("b"), "nested")._jdf.queryExecution().executedPlan().toString()


def test_hash_buckets(table, spark):
    v, df = table
    n = len(v)
    size = max(1, (1 << (max(n, 1).bit_length() - 1)) >> 1)
    of = lambda x: (x >> 1) & (size - 1)
    want, at = [], 0
    for b in sorted({of(x) for x in v}):
        k = sum(of(x) == b for x in v)
        want.append((b, at, at + k))
        at += k
    assert tuples(A.hash_bounds(df, "value", n)) == want
    s = spark.createDataFrame([(0, 3), (1, 4)], "sid long, w int")
    assert tuples(A.bucket_fetch(df, s, "value", "w", n).select("rid", "sid")) == sorted((i, j) for i, x in enumerate(v) for j, y in ((0, 3), (1, 4)) if of(x) == of(y))


def test_key_search(table, spark):
    v, df = table
    assert tuples(A.key_search(df, "value", 3)) == [(i, x) for i, x in enumerate(v) if x == 3]
    keys = spark.createDataFrame([(3,), (3,), (7,)], "k int")
    assert tuples(A.key_search_many(df, "value", keys, "k")) == sorted((i, x) for i, x in enumerate(v) for k in (3, 3, 7) if x == k)


def test_project_rids(table, spark):
    v, df = table
    rids = spark.createDataFrame([(0,), (0,), (5,)], "rid long")
    assert tuples(O.project_rids(df, rids, "value")) == sorted((r, v[r]) for r in (0, 0, 5) if r < len(v))


def test_no_task_sees_all_rows(spark):
    """A total order is cut into ranges: no exchange of rows into one partition."""
    df = spark.range(1000).withColumn("v", F.col("id") % 5)
    plan = P.exclusive_scan(df, "id", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 2 and "Aggregate" in plan
