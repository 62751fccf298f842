import pytest
from pyspark.sql import Row

from colonnade.plans import templates as T
from colonnade.plans.compiler import bounds, run_plan
from colonnade.plans.grammar import PlanError, both, compare, linearize, node, parse, parse_predicate

EXAMPLE = "PRO;R;$;R.a00,;$;:SEL;R;$;R.a00,;AND,>,R.a00,$,$,10,$,$,<,R.a00,$,$,20,$,$,;:$:$:$:"


@pytest.fixture(scope="module")
def tables(spark):
    r = spark.createDataFrame([Row(rid=i, a00=v, b00=i % 3) for i, v in enumerate([5, 10, 11, 15, 19, 20, -4, 15])])
    s = spark.createDataFrame([Row(a00=v) for v in [15, 15, 20, 7]])
    u = spark.createDataFrame([Row(k=15, w=1), Row(k=20, w=2)])
    return {"R": r, "S": s, "U": u}


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_example(spark, tables):
    root = parse(EXAMPLE)
    assert [n.op for n in linearize(root)] == ["SEL", "PRO"]
    assert values(run_plan(spark, EXAMPLE, tables)) == [(11,), (15,), (15,), (19,)]


def test_templates_write_what_is_parsed():
    assert parse(T.range_selection(10, 20)) == parse(EXAMPLE)
    for plan in (T.point_selection(1), T.aggregate(), T.order_by(), T.group_by(), T.nested_loop_join((1, 2), (3, 4)), T.equi_join(), T.benchmark_1(1, 2), T.benchmark_2(1, 2), T.benchmark_3(1, 2)):
        assert parse(plan)


def test_strict_and_inclusive(spark, tables):
    plan = node("SEL", "R", predicate=compare(">=", "R.a00", 15))
    assert {r.a00 for r in run_plan(spark, plan, tables).collect()} == {15, 19, 20}
    plan = node("SEL", "R", predicate=compare("<", 15, "R.a00"))
    assert {r.a00 for r in run_plan(spark, plan, tables).collect()} == {19, 20}


def test_boolean(spark, tables):
    pred = f"OR,{compare('=', 'R.a00', 5)}AND,{compare('<>', 'R.b00', 0)}{compare('<=', 'R.a00', -4)}"
    assert {r.a00 for r in run_plan(spark, node("SEL", "R", predicate=pred), tables).collect()} == {5}


def test_group_aggregate(spark, tables):
    assert values(run_plan(spark, T.group_by("AVG"), tables)) == [(0, 5), (1, 14), (2, 15)]
    assert values(run_plan(spark, T.group_by("COUNT"), tables)) == [(0, 3), (1, 3), (2, 2)]


def test_grouping_sees_the_filter(spark, tables):
    """A filter on another column below the grouping takes effect."""
    sel = node("SEL", "$", columns=("R.a00",), predicate=compare(">", "R.rid", 3))
    plan = node("AGG", "R", "MAX", ("R.a00",), left=node("GRP", "R", columns=("R.b00",), left=sel))
    assert values(run_plan(spark, plan, tables)) == [(0, -4), (1, 19), (2, 20)]


def test_theta_join(spark, tables):
    plan = T.nested_loop_join((9, 20), (10, 30))
    got = values(run_plan(spark, plan, tables))
    r, s = [10, 11, 15, 19, 15], [15, 15, 20]
    assert got == sorted((a,) for a in r for b in s if a < b)


@pytest.mark.parametrize("algorithm,physical", [("hash", "ShuffledHashJoin"), ("merge", "SortMergeJoin"), ("nested", "CartesianProduct")])
def test_algorithms(spark, tables, algorithm, physical):
    df = run_plan(spark, T.equi_join(), tables, algorithm)
    assert physical in df._jdf.queryExecution().executedPlan().toString()
    assert values(df) == [(15,)] * 4 + [(20,)]


def test_three_way_join(spark, tables):
    first = node("JOIN", "R", "S", ("R.a00", "S.a00"), compare("=", "R.a00", "S.a00"))
    plan = node("PRO", "R", columns=("R.rid", "U.w"), left=node("JOIN", "R", "U", ("R.a00", "U.k"), compare("=", "R.a00", "U.k"), first))
    assert values(run_plan(spark, plan, tables)) == [(3, 1), (3, 1), (5, 2), (7, 1), (7, 1)]


def test_same_names_are_told_apart(spark, tables):
    plan = node("JOIN", "R", "S", (), compare("=", "R.a00", "S.a00"))
    assert set(run_plan(spark, plan, tables).columns) == {"rid", "R_a00", "b00", "S_a00"}


def test_bounds():
    assert bounds(parse_predicate(compare("=", "R.a", 5))) == ("R.a", 5, 5)
    assert bounds(parse_predicate(both(compare("<", 1, "R.a"), compare("<=", "R.a", 9)))) == ("R.a", 2, 9)
    for bad in (compare("<>", "R.a", 1), both(compare("<", "R.a", 1), compare(">", "R.b", 1)), compare("=", "R.a", "R.b")):
        with pytest.raises(PlanError):
            bounds(parse_predicate(bad))


@pytest.mark.parametrize(
    "plan",
    [
        "", "$:", "NOP;R;$;R.a,;$;:$:$:", "SEL;R;$;R.a,;$;:$:$:", "SEL;R;$;R.a,;=,R.a,$,$,;:$:$:", "PRO;R;$;;$;:$:$:", "AGG;R;MODE;R.a,;$;:$:$:",
        "AGG;R;MAX;R.a,R.b,;$;:$:$:", "JOIN;R;$;R.a,;=,R.a,$,$,R.b,$,$,;:$:$:", EXAMPLE + "$:", EXAMPLE[:-4], "PRO;R;$;a00,;$;:$:$:", "SEL;R;$;;R.a;1,$,$,;:$:$:",
        "SEL;R;$;;drop table,$,$,;:$:$:", "SEL;R;$;;R.a,1,$,$,$,;:$:$:",
    ],
)
def test_bad_plans(plan):
    with pytest.raises(PlanError):
        parse(plan)


def test_unknown_table(spark, tables):
    with pytest.raises(PlanError):
        run_plan(spark, node("PRO", "X", columns=("X.a",)), tables)


def test_pushdown(spark):
    from colonnade import queries

    plan = queries.QUERIES["q_dbmbench1"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_partkey), GreaterThan(l_partkey,50), LessThan(l_partkey,150)]" in plan
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>" in plan
