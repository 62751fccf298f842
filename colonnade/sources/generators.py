"""Generated tables: deterministic, distributed, from a seed and the row's id alone."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The domain of generated integers, and the sizes and ranges of the benchmark tables.
DOMAIN = 1 << 30
T2_ROWS = 153_600
T1_KEYS, A2_VALUES, A3_VALUES = 150_000, 20_000, 50
ALPHABET_START, ALPHABET_SIZE = ord("A"), 52


def uniform(seed: int, most: int, rid: str = "rid") -> Column:
    return F.pmod(F.xxhash64(F.col(rid), F.lit(seed)), F.lit(most)).cast("int")


def rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "rid")


def random_table(spark: SparkSession, n: int, seed: int = 0, most: int = DOMAIN) -> DataFrame:
    return rows(spark, n).withColumn("value", uniform(seed, most))


def sorted_table(spark: SparkSession, n: int, table_id: int = 0) -> DataFrame:
    return rows(spark, n).withColumn("value", (F.col("rid") + table_id).cast("int"))


def distinct_table(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """A permutation of 0..n-1: an affine map modulo n by a multiplier without a common factor."""
    a = next(k for k in range(int(n * 0.618) + 1, 2 * n + 3) if gcd(k, n) == 1)
    return rows(spark, n).withColumn("value", F.pmod(F.col("rid") * a + (seed * 7919 + 1), F.lit(n)).cast("int"))


def skewed_table(spark: SparkSession, n: int, one_ratio: float, seed: int = 0, most: int = DOMAIN) -> DataFrame:
    """A share of the rows has value 1."""
    hot = F.pmod(F.xxhash64("rid", F.lit(seed + 1_000_003)), F.lit(1_000_000)) < int(one_ratio * 1_000_000)
    return rows(spark, n).withColumn("value", F.when(hot, F.lit(1)).otherwise(uniform(seed, most)))


def join_tables(spark: SparkSession, n: int, selectivity: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """R and S of n rows each; a share of S's rows have a partner in R, whose values are distinct."""
    r = rows(spark, n).withColumn("value", (F.col("rid") * 2).cast("int"))
    meets = F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(1_000_000)) < int(selectivity * 1_000_000)
    s = rows(spark, n).withColumn("value", (uniform(seed + 1, n) * 2 + F.when(meets, 0).otherwise(1)).cast("int"))
    return r, s


def string_table(spark: SparkSession, n: int, least: int = 1, most: int = 8, seed: int = 0) -> DataFrame:
    """(rid, key, val): keys of letters from ``A`` on over 52 code points, of least to most - 1 letters."""
    size = F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(most - least)) + least
    letter = lambda i: F.char(F.lit(ALPHABET_START) + F.pmod(F.xxhash64("rid", i, F.lit(seed + 1)), F.lit(ALPHABET_SIZE)))
    key = F.array_join(F.transform(F.sequence(F.lit(1), size.cast("int")), letter), "")
    return rows(spark, n).withColumn("key", key).withColumn("val", F.col("rid").cast("string").cast("binary"))


def benchmark_tables(spark: SparkSession, scale: int = 1) -> dict[str, DataFrame]:
    """T2: key a1 (a permutation), a2, a3. T1: foreign key a1, a2, a3; scale times as many rows."""
    t2 = distinct_table(spark, T2_ROWS).withColumnRenamed("value", "a1")
    t2 = t2.withColumn("a2", uniform(2, A2_VALUES)).withColumn("a3", uniform(3, A3_VALUES))
    t1 = rows(spark, T2_ROWS * scale).withColumn("a1", uniform(11, T1_KEYS)).withColumn("a2", uniform(12, A2_VALUES)).withColumn("a3", uniform(13, A3_VALUES))
    return {"T1": t1, "T2": t2}


def query_tables(spark: SparkSession, n: int) -> dict[str, DataFrame]:
    """R(a00, b00 in 0..63) and S(a00)."""
    r = random_table(spark, n, 0).withColumnRenamed("value", "a00")
    r = r.withColumn("b00", F.pmod(uniform(100, DOMAIN), F.lit(64)).cast("int"))
    return {"R": r, "S": random_table(spark, n, 1).withColumnRenamed("value", "a00")}


def default_tables(spark: SparkSession, scale: int = 1) -> dict[str, DataFrame]:
    """TempR, TempS: columns a to h; TempT, TempU: a and b (sorted)."""
    out, seed = {}, 0
    for name in ("TempR", "TempS"):
        df = rows(spark, 32_768 * scale)
        for c in "abcdefgh":
            df, seed = df.withColumn(c, uniform(seed, DOMAIN)), seed + 1
        out[name] = df
    for name in ("TempT", "TempU"):
        df = rows(spark, 8_388_608 * scale).withColumn("a", uniform(seed, DOMAIN))
        out[name], seed = df.withColumn("b", (F.col("rid") + seed).cast("int")), seed + 1
    return out
