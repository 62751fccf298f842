import pytest

from colonnade.plans.batch import run_batch
from colonnade.plans.compiler import run_plan
from colonnade.plans import templates as T
from colonnade.sources import columns, generators as G
from colonnade.sources.catalog import Catalog, parse_config
from colonnade.streaming import running_group_aggregate


def test_config():
    text = "[Indexes]\nx\n[/Indexes]\n[Tables]\nR.a00\n/a\n\nR.b00\n/b\n[/Tables]\nrest"
    assert parse_config(text) == {"R.a00": "/a", "R.b00": "/b"}
    for bad in ("[Tables]\nR.a\n[/Tables]", "[Tables]\nR\n/a\nR\n/b\n[/Tables]", "[Tables]\nR"):
        with pytest.raises(ValueError):
            parse_config(bad)


def test_catalog(spark, tmp_path):
    c = Catalog(spark)
    c.add("CatR", G.random_table(spark, 50).withColumnRenamed("value", "a00"))
    c.add("CatS", G.sorted_table(spark, 20, 3), sorted_by="value")
    assert c.names() == ["CatR", "CatS"] and c.id("CatS") == 1 and c.check("CatR") and not c.check("X")
    assert c.length("CatR") == 50 and c.property("CatS").sorted_by == "value"
    with pytest.raises(ValueError):
        c.add("CatR", spark.range(1).toDF("rid"))
    with pytest.raises(KeyError):
        c.table("X")
    assert c.column("CatR.a00").columns == ["a00"]
    c.sort("CatR", "a00")
    assert c.property("CatR").sorted_by == "a00"
    assert "Sort" not in c.table("CatR")._jdf.queryExecution().executedPlan().toString()
    for part in c.table("CatR").select("a00").rdd.glom().collect():
        assert [r.a00 for r in part] == sorted(r.a00 for r in part) or len(part) > 1
    index = c.build_index("CatS", "value", 2)
    assert c.index("CatS", "value") == index and c.index("CatR", "a00") is None and index.table(spark).count() == 20
    with pytest.raises(ValueError):
        c.build_index("CatS", "value", 3)
    c.dump(str(tmp_path / "conf"), str(tmp_path / "data"))
    before = sorted(map(tuple, c.table("CatR").select("rid", "a00").collect()))
    c.drop("CatR")
    c.drop("CatS")
    assert not c.check("CatR")
    d = Catalog(spark)
    assert d.load(str(tmp_path / "conf")) == ["CatR", "CatS"]
    assert sorted(map(tuple, d.table("CatR").select("rid", "a00").collect())) == before
    d.drop("CatR")
    d.drop("CatS")


def test_column_file_with_counts(spark, tmp_path):
    (tmp_path / "c.txt").write_text("3\n3\n0 5\n1 -6\n2 7\n")
    assert sorted(map(tuple, columns.read_column(spark, str(tmp_path / "c.txt")).collect())) == [(0, 5), (1, -6), (2, 7)]


def test_row_file(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3), (4, 5, 6)], "a1 int, a2 int, a3 int").coalesce(1)
    columns.write_rows(df, str(tmp_path / "t"), ["a1", "a2", "a3"])
    got = columns.read_rows(spark, str(tmp_path / "t"), ["a1", "a2", "a3"])
    assert sorted(map(tuple, got.collect())) == [(0, 1, 2, 3), (1, 4, 5, 6)]
    many = [(i, 3 * i, 7) for i in range(5000)]
    spark.createDataFrame(many, "a1 int, a2 int, a3 int").coalesce(1).write.mode("overwrite").csv(str(tmp_path / "many"), sep=" ")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:  # a file of several splits
        got = columns.read_rows(spark, str(tmp_path / "many"), ["a1", "a2", "a3"])
        assert sorted(map(tuple, got.collect())) == [(i, *r) for i, r in enumerate(many)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "bad.txt").write_text("1 -2 3\n")
    with pytest.raises(Exception, match="not a row"):
        columns.read_rows(spark, str(tmp_path / "bad.txt"), ["a1", "a2", "a3"]).collect()


def values(df):
    return [r.value for r in df.orderBy("rid").collect()]


def test_generators(spark):
    assert values(G.random_table(spark, 100, 1)) == values(G.random_table(spark, 100, 1)) != values(G.random_table(spark, 100, 2))
    assert all(0 <= v < G.DOMAIN for v in values(G.random_table(spark, 100)))
    assert values(G.sorted_table(spark, 5, 2)) == [2, 3, 4, 5, 6]
    for n in (1, 2, 97, 100, 1000):
        assert sorted(values(G.distinct_table(spark, n))) == list(range(n))
    skew = values(G.skewed_table(spark, 4000, 0.5))
    assert 0.45 < sum(v == 1 for v in skew) / 4000 < 0.55
    for share in (0.0, 0.3, 1.0):
        r, s = G.join_tables(spark, 2000, share)
        known = set(values(r))
        assert abs(sum(v in known for v in values(s)) / 2000 - share) < 0.05
    keys = [r.key for r in G.string_table(spark, 200, 2, 6).collect()]
    assert all(2 <= len(k) < 6 and all(65 <= ord(x) < 65 + 52 for x in k) for k in keys) and len(set(keys)) > 150


def test_benchmark_tables_run_plans(spark):
    t = G.benchmark_tables(spark)
    assert t["T1"].count() == t["T2"].count() == G.T2_ROWS
    (row,) = run_plan(spark, T.benchmark_2(1000, 4000), t).collect()
    assert 20 <= row.avg_a3 <= 30
    assert set(G.default_tables(spark)) == {"TempR", "TempS", "TempT", "TempU"}
    q = G.query_tables(spark, 1000)
    assert len(run_plan(spark, T.group_by("MAX"), q).collect()) == 64


def test_batch(spark):
    q = {f"q{i}": (lambda i=i: spark.range(i * 10)) for i in range(6)} | {"bad": lambda: spark.table("no_such_table")}
    done = run_batch(spark, q, workers=3)
    assert {d.name: d.result for d in done if d.error is None} == {f"q{i}": i * 10 for i in range(6)}
    assert [d.name for d in done if d.error] == ["bad"]
    order = run_batch(spark, {k: q[k] for k in ("q1", "q2", "q3")}, workers=1, cost=lambda n: int(n[1]))
    assert [d.name for d in order] == ["q3", "q2", "q1"]


def test_running_aggregate(spark, tmp_path):
    spark.createDataFrame([(1, 5), (1, 7), (2, 9)], "k int, v int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, v int").parquet(str(tmp_path / "in"))
    run = running_group_aggregate(stream, "k", "MAX", "v", "m").writeStream.outputMode("complete").format("memory").queryName("running").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("running").collect())) == [(1, 7), (2, 9)]
