"""The registered queries over the driver's tables, each with the SQL that gives the same rows.

R is orders (a00: o_custkey, b00: o_orderkey modulo 64), S is customer (a00: c_custkey), T1 is
lineitem (a1: l_orderkey, a2: l_partkey, a3: l_suppkey), T2 is orders (a1: o_orderkey).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fields as FL
from .functions import hashing as H
from .functions import primitives as P
from .operators import access as A
from .operators import joins as J
from .operators import relational as O
from .plans import templates as T
from .plans.batch import run_batch
from .plans.compiler import run_plan
from .sources import columns
from .sources import generators as G
from .sources.catalog import Catalog
from .sources.indexes import build_index
from .sources.scratch import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str):
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, d, f=f: f(lambda t: spark.read.parquet(f"{d}/{t}.parquet"))
        ORACLES[name] = sql
        return f

    return add


# -- selection and projection -------------------------------------------------------------------

_LINE = "l_orderkey, l_linenumber"
for _name, _cond, _sql in (
    ("sel_point", lambda d: O.point_selection(d, "l_partkey", 77), "l_partkey = 77"),
    ("sel_range", lambda d: O.range_selection(d, "l_partkey", 100, 150), "l_partkey BETWEEN 100 AND 150"),
    ("sel_dispatch", lambda d: O.selection(d, "l_partkey", 77, 77), "l_partkey = 77"),
    ("sel_range_strict", lambda d: d.where("l_partkey > 100 and l_partkey < 150"), "l_partkey > 100 AND l_partkey < 150"),
    ("sel_or", lambda d: d.where((F.col("l_partkey") == 77) | (F.col("l_suppkey") == 5)), "l_partkey = 77 OR l_suppkey = 5"),
    ("sel_ne", lambda d: d.where((F.col("l_linenumber") != 1) & (F.col("l_partkey") <= 50)), "l_linenumber <> 1 AND l_partkey <= 50"),
    ("sel_flipped", lambda d: d.where((F.lit(100) < F.col("l_partkey")) & (F.lit(150) >= F.col("l_partkey"))), "100 < l_partkey AND 150 >= l_partkey"),
):
    register(_name, f"SELECT {_LINE}, l_partkey FROM lineitem WHERE {_sql}")(
        lambda t, c=_cond: c(t("lineitem")).select("l_orderkey", "l_linenumber", "l_partkey")
    )

register("project", "SELECT o_custkey, o_totalprice FROM orders")(lambda t: O.project(t("orders"), "o_custkey", "o_totalprice"))


@register(
    "project_rids",
    "SELECT o.o_orderkey, o.o_custkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_partkey BETWEEN 100 AND 150",
)
def _(t):
    rids = O.range_selection(t("lineitem"), "l_partkey", 100, 150).select(F.col("l_orderkey").alias("o_orderkey"))
    return O.project_rids(t("orders"), rids, "o_custkey", rid="o_orderkey")


@register(
    "compose_rids",
    "SELECT l.l_orderkey AS rid, o.o_custkey AS value FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_quantity < 5",
)
def _(t):
    outer = t("lineitem").where("l_quantity < 5").select(F.col("l_orderkey").alias("rid"), F.col("l_orderkey").alias("value"))
    return O.compose_rids(outer, t("orders").select(F.col("o_orderkey").alias("rid"), F.col("o_custkey").alias("value")))


# -- aggregation --------------------------------------------------------------------------------

_SQL_AGG = {"SUM": "sum({c})::BIGINT", "MAX": "max({c})", "MIN": "min({c})", "AVG": "(sum({c}) // count({c}))::BIGINT", "COUNT": "count({c})"}
for _op, _agg in _SQL_AGG.items():
    register(f"agg_{_op.lower()}", f"SELECT {_agg.format(c='l_suppkey')} AS v FROM lineitem")(
        lambda t, op=_op: O.aggregate(t("lineitem"), op, "l_suppkey", "v")
    )
    register(f"group_{_op.lower()}", f"SELECT l_suppkey, {_agg.format(c='l_partkey')} AS v FROM lineitem GROUP BY l_suppkey")(
        lambda t, op=_op: O.group_aggregate(t("lineitem"), "l_suppkey", op, "l_partkey", "v")
    )
register("agg_avg_empty", "SELECT (sum(l_suppkey) // count(l_suppkey))::BIGINT AS v FROM lineitem WHERE l_partkey < 0")(
    lambda t: O.aggregate(t("lineitem").where("l_partkey < 0"), "AVG", "l_suppkey", "v")
)
register("agg_avg_negative", "SELECT (sum(-l_suppkey) // count(l_suppkey))::BIGINT AS v FROM lineitem")(
    lambda t: t("lineitem").agg(O.int_avg(-F.col("l_suppkey")).alias("v"))
)
register(
    "reduce_partial_final",
    "SELECT sum(l_suppkey)::BIGINT AS s, max(l_suppkey) AS hi, min(l_suppkey) AS lo, count(*) AS n FROM lineitem",
)(lambda t: P.reduce_(t("lineitem"), F.sum("l_suppkey").alias("s"), F.max("l_suppkey").alias("hi"), F.min("l_suppkey").alias("lo"), F.count("*").alias("n")))
_GROUPS = "WITH g AS (SELECT l_suppkey, count(*) AS n, max(l_partkey) AS v FROM lineitem GROUP BY l_suppkey) "
register(
    "group_positions",
    _GROUPS + "SELECT row_number() OVER (ORDER BY l_suppkey) - 1 AS ordinal, l_suppkey, (sum(n) OVER (ORDER BY l_suppkey) - n)::BIGINT AS start_pos, "
    "(sum(n) OVER (ORDER BY l_suppkey))::BIGINT AS end_pos FROM g",
)(lambda t: O.group_positions(t("lineitem"), "l_suppkey"))
register("group_ordinal_max", _GROUPS + "SELECT row_number() OVER (ORDER BY l_suppkey) - 1 AS ordinal, v FROM g")(
    lambda t: O.group_ordinals(t("lineitem"), "l_suppkey", "MAX", "l_partkey", "v")
)
register("distinct_values", "SELECT DISTINCT l_suppkey FROM lineitem")(lambda t: O.distinct_values(t("lineitem"), "l_suppkey"))

# -- order --------------------------------------------------------------------------------------

register(
    "order_by_positions",
    "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS pos FROM orders",
)(lambda t: O.order_positions(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey"))
register("order_then_max", "SELECT max(o_custkey) AS v FROM orders")(
    lambda t: O.aggregate(O.order_by(t("orders").select("o_custkey"), "o_custkey"), "MAX", "o_custkey", "v")
)
register(
    "sort_segments",
    "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS pos FROM orders",
)(lambda t: O.segment_ranks(t("orders"), "o_custkey", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "pos"))
register(
    "quantile_positions",
    "WITH p AS (SELECT o_custkey AS value, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS at, "
    "rank() OVER (ORDER BY o_custkey) - 1 AS pos, count(*) OVER () AS n FROM orders), "
    "k AS (SELECT unnest(range(16)) AS quantile) "
    "SELECT quantile::INT AS quantile, pos, value FROM k JOIN p ON p.at = quantile * n // 16",
)(lambda t: P.quantile_positions(t("orders"), "o_custkey", 16))
register(
    "interval_bounds",
    "WITH p AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS pos FROM orders) "
    "SELECT pos // 256 AS interval, min(o_custkey) AS min_value, max(o_custkey) + 1 AS max_value FROM p GROUP BY 1",
)(lambda t: P.interval_bounds(t("orders"), "o_custkey", "o_orderkey", 256))
register(
    "lower_bound",
    "WITH v AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) "
    "SELECT c_custkey AS k, coalesce((SELECT sum(n) FROM v WHERE o_custkey < c_custkey), 0)::BIGINT AS pos, "
    "EXISTS (SELECT 1 FROM v WHERE o_custkey = c_custkey) AS found FROM customer",
)(lambda t: P.lower_bound(t("orders"), "o_custkey", t("customer").select(F.col("c_custkey").alias("k")), "k"))
register(
    "string_sort",
    "SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS pos FROM part",
)(lambda t: P.string_sort(t("part").select("p_partkey", "p_name"), "p_name", "p_partkey"))
register(
    "string_key_ranges",
    "WITH g AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1) SELECT p_name, (sum(n) OVER w - n)::BIGINT AS start_pos, "
    "(sum(n) OVER w)::BIGINT AS end_pos FROM g WINDOW w AS (ORDER BY p_name)",
)(lambda t: P.string_key_ranges(t("part"), "p_name"))

# -- joins --------------------------------------------------------------------------------------

_EQUI = "SELECT o_orderkey, c_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey"
_on = lambda: F.col("o_custkey") == F.col("c_custkey")
for _alg in ("nested", "merge", "hash"):
    register(f"join_{_alg}" + ("_equi" if _alg == "nested" else ""), _EQUI)(
        lambda t, a=_alg: J.join(t("orders"), t("customer"), _on(), a).select("o_orderkey", "c_custkey", "c_nationkey")
    )
register("join_index", _EQUI)(lambda t: J.index_join(t("orders"), t("customer"), _on()).select("o_orderkey", "c_custkey", "c_nationkey"))


@register("join_presorted_merge", _EQUI)
def _(t):
    orders, customer = t("orders").select("o_orderkey", "o_custkey"), t("customer").select("c_custkey", "c_nationkey")
    buckets = int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = build_index(orders, "o_custkey", buckets), build_index(customer, "c_custkey", buckets)
    return J.presorted_merge_join(orders.sparkSession, *sides).select("o_orderkey", "c_custkey", "c_nationkey")


register("join_pairs", "SELECT o_orderkey AS r_rid, c_custkey AS s_rid FROM orders JOIN customer ON o_custkey = c_custkey")(
    lambda t: J.join_pairs(t("orders"), t("customer"), "o_orderkey", "c_custkey", _on())
)
register(
    "join_nested_theta",
    "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey < c_custkey "
    "WHERE o_custkey > 10 AND o_custkey < 60 AND c_custkey > 20 AND c_custkey < 120",
)(
    lambda t: J.theta_join(
        t("orders").where("o_custkey > 10 and o_custkey < 60"), t("customer").where("c_custkey > 20 and c_custkey < 120"), F.col("o_custkey") < F.col("c_custkey")
    ).select("o_orderkey", "c_custkey")
)
register(
    "join_band",
    "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON abs(s_suppkey * 7 - c_custkey) <= 3",
)(
    lambda t: J.band_join(t("supplier").withColumn("k", F.col("s_suppkey") * 7), t("customer"), "k", "c_custkey", 3).select("s_suppkey", "c_custkey")
)
register(
    "join_interval_overlap",
    "WITH r AS (SELECT p_partkey, p_partkey AS lo, p_partkey + p_size AS hi FROM part), "
    "s AS (SELECT s_suppkey, s_suppkey * 20 AS lo, s_suppkey * 20 + s_nationkey AS hi FROM supplier) "
    "SELECT p_partkey, s_suppkey FROM r JOIN s ON r.lo <= s.hi AND s.lo <= r.hi",
)(
    lambda t: J.overlap_join(
        t("part").select("p_partkey", F.col("p_partkey").alias("rlo"), (F.col("p_partkey") + F.col("p_size")).alias("rhi")),
        t("supplier").select("s_suppkey", (F.col("s_suppkey") * 20).alias("slo"), (F.col("s_suppkey") * 20 + F.col("s_nationkey")).alias("shi")),
        "rlo", "rhi", "slo", "shi",
    ).select("p_partkey", "s_suppkey")
)
_HOT = "CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END"
register("join_skew", f"SELECT o_orderkey, c_custkey FROM (SELECT o_orderkey, {_HOT} AS k FROM orders) JOIN customer ON k = c_custkey")(
    lambda t: J.join(t("orders").select("o_orderkey", F.expr(_HOT).alias("k")), t("customer"), F.col("k") == F.col("c_custkey"), "merge").select("o_orderkey", "c_custkey")
)
register(
    "join_selectivity",
    "SELECT o_orderkey, s_suppkey FROM orders JOIN supplier ON o_custkey = s_suppkey",
)(lambda t: J.join(t("orders"), t("supplier"), F.col("o_custkey") == F.col("s_suppkey"), "hash").select("o_orderkey", "s_suppkey"))
register(
    "join_three_way",
    "SELECT c_nationkey, count(*) AS n, sum(l_suppkey)::BIGINT AS s FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
)(
    lambda t: t("lineitem")
    .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    .join(t("customer"), _on())
    .groupBy("c_nationkey")
    .agg(F.count("*").alias("n"), F.sum("l_suppkey").alias("s"))
)

register(
    "join_interval_overlap_long",
    "WITH r AS (SELECT o_orderkey, o_custkey AS lo, CASE WHEN o_orderkey % 1000 = 0 THEN 1000000000 ELSE o_custkey + o_orderkey % 7 END AS hi FROM orders), "
    "s AS (SELECT s_suppkey, s_suppkey * 11 AS lo, s_suppkey * 11 + s_nationkey * s_nationkey AS hi FROM supplier) "
    "SELECT s_suppkey, count(*) AS n FROM r JOIN s ON r.lo <= s.hi AND s.lo <= r.hi GROUP BY s_suppkey",
)(
    lambda t: J.overlap_join(
        t("orders").select(F.col("o_custkey").alias("rlo"), F.expr("case when o_orderkey % 1000 = 0 then 1000000000 else o_custkey + o_orderkey % 7 end").alias("rhi")),
        t("supplier").select("s_suppkey", F.expr("s_suppkey * 11").alias("slo"), F.expr("s_suppkey * 11 + s_nationkey * s_nationkey").alias("shi")),
        "rlo", "rhi", "slo", "shi",
    ).groupBy("s_suppkey").agg(F.count("*").alias("n"))
)

# -- primitives ---------------------------------------------------------------------------------

register("map_extract", "SELECT o_orderkey, o_custkey AS value FROM orders")(lambda t: P.map_(t("orders"), lambda c: c, "o_custkey", keep=("o_orderkey",)))
register("map_mod", "SELECT o_orderkey, o_custkey % 64 AS value FROM orders")(lambda t: P.map_(t("orders"), lambda c: H.mod_part(c, 64), "o_custkey", keep=("o_orderkey",)))
register("map_fill", "SELECT o_orderkey, 7 AS value FROM orders")(lambda t: P.map_(t("orders"), lambda: F.lit(7), keep=("o_orderkey",)))
_LOC = "(o_orderkey * 7 + 3) % (SELECT count(*) FROM orders)"


def _rows(df: DataFrame) -> Column:
    """The number of rows, counted when the query runs."""
    return df.agg(F.count("*")).scalar()


def _located(t):
    o = t("orders").select("o_orderkey", "o_custkey")
    return o.withColumn("loc", F.pmod(F.col("o_orderkey") * 7 + 3, _rows(o)))


register("scatter_perm", f"SELECT {_LOC} AS pos, o_custkey FROM orders")(lambda t: P.scatter(_located(t), "loc", "o_custkey", "o_orderkey"))
register(
    "gather_perm",
    f"WITH p AS (SELECT o_orderkey AS place, {_LOC} AS loc FROM orders) SELECT place, o_orderkey, o_custkey FROM p JOIN orders ON loc = o_orderkey",
)(
    lambda t: P.gather(t("orders").select("o_orderkey", "o_custkey"), _located(t).select(F.col("o_orderkey").alias("place"), "loc"), "loc", "o_orderkey").select(
        "place", "o_orderkey", "o_custkey"
    )
)
register(
    "scan_exclusive",
    "SELECT o_orderkey, coalesce(sum(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS scan FROM orders",
)(lambda t: P.exclusive_scan(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey").select("o_orderkey", "scan"))
register("scan_total", "SELECT sum(o_custkey)::BIGINT AS total FROM orders")(lambda t: t("orders").agg(F.sum("o_custkey").alias("total")))
_SPLITS = {
    "mod": (lambda c: H.mod_part(c, 64), "o_custkey % 64"),
    "radix": (lambda c: H.radix_part(c, 2, 4), "(o_custkey >> 2) & 15"),
    "pivots": (lambda c: H.pivot_part(c, [20, 50, 90, 140]), "(o_custkey >= 20)::INT + (o_custkey >= 50)::INT + (o_custkey >= 90)::INT + (o_custkey >= 140)::INT"),
}
for _kind, (_part, _sql) in _SPLITS.items():
    register(f"split_{_kind}", f"SELECT o_orderkey, {_sql} AS part, row_number() OVER (ORDER BY {_sql}, o_orderkey) - 1 AS pos FROM orders")(
        lambda t, p=_part: P.split(t("orders").select("o_orderkey", "o_custkey"), p(F.col("o_custkey")), "o_orderkey").select("o_orderkey", "part", "pos")
    )
register(
    "split_starts",
    "WITH g AS (SELECT o_custkey % 64 AS part, count(*) AS n FROM orders GROUP BY 1) SELECT part, (sum(n) OVER (ORDER BY part) - n)::BIGINT AS start_pos, n FROM g",
)(lambda t: P.split_starts(t("orders"), H.mod_part(F.col("o_custkey"), 64)))
_RS = "0"
for _i, _a in enumerate((9, 47, 25, 31)):  # the multipliers modulo 64
    _RS = f"((({_RS}) * {_a} + (o_custkey >> {24 - 8 * _i})) & 63)"
register("partition_rs", f"SELECT o_orderkey, ({_RS})::BIGINT AS part FROM orders")(
    lambda t: t("orders").select("o_orderkey", H.rs_part(F.col("o_custkey"), 64).alias("part"))
)

# -- lookups ------------------------------------------------------------------------------------

_N = "(SELECT count(*) FROM orders)"
_SIZE = f"(greatest(1, (1 << floor(log2({_N}))::INT) >> 1) - 1)"
register(
    "hash_bounds",
    f"WITH g AS (SELECT (o_custkey >> 1) & {_SIZE} AS bucket, count(*) AS n FROM orders GROUP BY 1) "
    "SELECT bucket, (sum(n) OVER (ORDER BY bucket) - n)::BIGINT AS start_pos, (sum(n) OVER (ORDER BY bucket))::BIGINT AS end_pos FROM g",
)(lambda t: A.hash_bounds(t("orders"), "o_custkey", _rows(t("orders"))))
register("hash_search", "SELECT o_orderkey, s_suppkey FROM orders JOIN supplier ON o_custkey = s_suppkey")(
    lambda t: A.hash_search(t("orders"), t("supplier"), "o_custkey", "s_suppkey", _rows(t("orders"))).select("o_orderkey", "s_suppkey")
)
register(
    "bucket_fetch",
    f"SELECT o_orderkey, s_suppkey FROM orders JOIN supplier ON (o_custkey >> 1) & {_SIZE} = (s_suppkey >> 1) & {_SIZE}",
)(lambda t: A.bucket_fetch(t("orders"), t("supplier"), "o_custkey", "s_suppkey", _rows(t("orders"))).select("o_orderkey", "s_suppkey"))
register("key_search_one", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7")(
    lambda t: A.key_search(t("orders"), "o_custkey", 7).select("o_orderkey", "o_custkey")
)
register("key_search_many", "SELECT o_orderkey, o_custkey FROM orders JOIN lineitem ON o_custkey = l_suppkey WHERE l_partkey = 77")(
    lambda t: A.key_search_many(t("orders"), "o_custkey", t("lineitem").where("l_partkey = 77"), "l_suppkey").select("o_orderkey", "o_custkey")
)
register("tree_search", "SELECT o_orderkey AS r_rid, s_suppkey AS s_rid FROM orders JOIN supplier ON o_custkey = s_suppkey")(
    lambda t: A.tree_search(t("orders"), t("supplier"), "o_custkey", "s_suppkey").select(F.col("o_orderkey").alias("r_rid"), F.col("s_suppkey").alias("s_rid"))
)

register(
    "order_descending",
    "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey % 100 DESC, o_orderkey) - 1 AS pos FROM orders",
)(lambda t: O.order_positions(t("orders").select("o_orderkey", "o_custkey"), (F.col("o_custkey") % 100).desc(), "o_orderkey"))


@register("index_search", "SELECT o_orderkey, o_custkey FROM orders JOIN supplier ON o_custkey = s_suppkey")
def _(t):
    orders = t("orders").select("o_orderkey", "o_custkey")
    spark = orders.sparkSession
    index = build_index(orders, "o_custkey", int(spark.conf.get("spark.sql.shuffle.partitions")))
    return A.index_search(spark, index, t("supplier"), "s_suppkey")


# -- records of four integers -------------------------------------------------------------------


def _records(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", FL.record("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("r"))


register("fields_take", "SELECT l_orderkey, l_linenumber, l_partkey AS y, l_linenumber AS w FROM lineitem")(
    lambda t: _records(t).select("l_orderkey", "l_linenumber", FL.take_fields(F.col("r"), "y", "w").alias("q")).select("l_orderkey", "l_linenumber", "q.y", "q.w")
)
register("fields_put", "SELECT l_orderkey AS x, l_partkey AS y, l_partkey + 1 AS z, 7 AS w FROM lineitem")(
    lambda t: _records(t).select(FL.put_fields(F.col("r"), {"z": F.col("r.y") + 1, "w": F.lit(7)}).alias("q")).select("q.*")
)

# -- sources ------------------------------------------------------------------------------------


@register("source_text_column", "SELECT o_orderkey AS rid, o_custkey::INT AS value FROM orders")
def _(t):
    orders = t("orders").select(F.col("o_orderkey").alias("rid"), F.col("o_custkey").cast("int").alias("value"))
    columns.write_column(orders, path := scratch(orders.sparkSession, "column"))
    return columns.read_column(orders.sparkSession, path)


@register("source_text_rows", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS rid, o_orderkey::INT AS a1, o_custkey::INT AS a2 FROM orders")
def _(t):
    rows = t("orders").select(F.col("o_orderkey").alias("a1"), F.col("o_custkey").alias("a2")).orderBy("a1")
    columns.write_rows(rows, path := scratch(rows.sparkSession, "rows"), ["a1", "a2"])
    return columns.read_rows(rows.sparkSession, path, ["a1", "a2"])


@register("source_catalog", "SELECT o_orderkey AS rid, o_custkey::INT AS a00, (o_orderkey % 64)::INT AS b00 FROM orders")
def _(t):
    """A catalog is dumped to files and loaded again."""
    r = t("orders").select(F.col("o_orderkey").alias("rid"), F.col("o_custkey").cast("int").alias("a00"), F.pmod("o_orderkey", F.lit(64)).cast("int").alias("b00"))
    spark, name = r.sparkSession, f"R{uuid.uuid4().hex}"
    first, again, folder = Catalog(spark), Catalog(spark), scratch(r.sparkSession, "catalog")
    first.add(name, r)
    first.sort(name, "a00")
    first.dump(f"{folder}/conf", f"{folder}/data")
    first.drop(name)
    again.load(f"{folder}/conf")
    table = again.table(name)
    again.drop(name)
    return table.select("rid", "a00", "b00")


register("source_sorted_table", "SELECT range AS rid, (range + 3)::INT AS value FROM range(20000)")(lambda t: G.sorted_table(t("region").sparkSession, 20_000, 3))
register("source_distinct_table", "SELECT range::INT AS value FROM range(20000)")(lambda t: G.distinct_table(t("region").sparkSession, 20_000).select("value"))
register(
    "source_benchmark_tables",
    "SELECT 307200::BIGINT AS n1, 153600::BIGINT AS n2, 153600::BIGINT AS keys, 0::INT AS low, 153599::INT AS high, true AS in_range",
)(
    lambda t: (lambda b: b["T2"].agg(F.count("*").alias("n2"), F.countDistinct("a1").alias("keys"), F.min("a1").alias("low"), F.max("a1").alias("high")).crossJoin(
        b["T1"].agg(F.count("*").alias("n1"), ((F.min("a1") >= 0) & (F.max("a1") < G.T1_KEYS) & (F.max("a2") < G.A2_VALUES) & (F.max("a3") < G.A3_VALUES)).alias("in_range"))
    ))(G.benchmark_tables(t("region").sparkSession, 2))
)


@register("batch", "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def _(t):
    """Three queries at once, by two workers."""
    done = run_batch(t("region").sparkSession, {name: lambda name=name: t(name) for name in ("customer", "orders", "part")})
    return t("region").sparkSession.createDataFrame([(d.name, d.result) for d in done], "name string, n long")


# -- the templates, from plan strings -----------------------------------------------------------


def tables(t: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
    o, c, l = t("orders"), t("customer"), t("lineitem")  # noqa: E741
    return {
        "R": o.select(F.col("o_custkey").alias("a00"), F.pmod("o_orderkey", F.lit(64)).alias("b00")),
        "S": c.select(F.col("c_custkey").alias("a00")),
        "T1": l.select(F.col("l_orderkey").alias("a1"), F.col("l_partkey").alias("a2"), F.col("l_suppkey").alias("a3")),
        "T2": o.select(F.col("o_orderkey").alias("a1")),
    }


def template(name: str, plan: str, sql: str, algorithm: str | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return run_plan(spark, plan, tables(lambda t: spark.read.parquet(f"{d}/{t}.parquet")), algorithm)

    QUERIES[name], ORACLES[name] = run, sql


_JOINED = "SELECT o_custkey AS a00 FROM orders JOIN customer ON o_custkey = c_custkey"
template("q_point", T.point_selection(77), "SELECT o_custkey AS a00 FROM orders WHERE o_custkey = 77")
template("q_range", T.range_selection(10, 60), "SELECT o_custkey AS a00 FROM orders WHERE o_custkey > 10 AND o_custkey < 60")
template("q_agg", T.aggregate("MAX"), "SELECT max(o_custkey) AS max_a00 FROM orders")
template("q_orderby", T.order_by("MAX"), "SELECT max(o_custkey) AS max_a00 FROM orders")
template("q_group", T.group_by("MAX"), "SELECT o_orderkey % 64 AS b00, max(o_custkey) AS max_a00 FROM orders GROUP BY 1")
template(
    "q_ninlj",
    T.nested_loop_join((10, 60), (20, 120)),
    "SELECT o_custkey AS a00 FROM orders JOIN customer ON o_custkey < c_custkey WHERE o_custkey > 10 AND o_custkey < 60 AND c_custkey > 20 AND c_custkey < 120",
)
template("q_inlj", T.equi_join(), _JOINED, "index")
template("q_smj", T.equi_join(), _JOINED, "merge")
template("q_hj", T.equi_join(), _JOINED, "hash")
template("q_dbmbench1", T.benchmark_1(50, 100), "SELECT l_suppkey AS a3 FROM lineitem WHERE l_partkey > 50 AND l_partkey < 150")
template(
    "q_dbmbench2",
    T.benchmark_2(50, 100),
    "SELECT (sum(l_suppkey) // count(l_suppkey))::BIGINT AS avg_a3 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey > 50 AND l_partkey < 150",
)
template("q_dbmbench3", T.benchmark_3(50, 50), "SELECT (sum(l_suppkey) // count(l_suppkey))::BIGINT AS avg_a3 FROM lineitem WHERE l_partkey > 50 AND l_partkey < 100")


@register(
    "flagship",
    "SELECT count(*) AS n, sum(l_suppkey)::BIGINT AS total, (sum(l_suppkey) // count(l_suppkey))::BIGINT AS avg_suppkey "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey > 50 AND l_partkey < 150",
)
def flagship(t):
    few = t("lineitem").where("l_partkey > 50 and l_partkey < 150").select("l_orderkey", "l_suppkey")
    joined = few.join(t("orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.agg(F.count("*").alias("n"), F.sum("l_suppkey").alias("total"), O.int_avg("l_suppkey").alias("avg_suppkey"))
