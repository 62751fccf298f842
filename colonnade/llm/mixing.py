"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same number of expected copies, target / source size. The
documents of a source stand in one order, their expected copies are summed up to each of them,
one random offset per source is added, and a document is emitted once for each integer boundary
its interval crosses. Ordering by size makes the sample a stratified one, so the words taken
differ from the target by about the size of one document.

Defined cases: a null text has size 0; null is a source of its own, the last one; a source
without words has target 0 and nothing of it is taken; rows that repeat (even their doc_id) are
rows of their own; an empty table gives an empty result; other columns are not read, whatever
their names (a frame that has a column ``_metadata`` or is no plain file scan is written first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, keyed, materialize, partitions, with_keys


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2
) -> DataFrame:
    """(source, source_size) -> also ``target``, by water filling in closed form.

    Targets are min(most * size, level * weight) with the one level at which they add up to the
    share of all sizes. In the order of cap / weight, the sources that stop at their cap are a
    prefix, so the level follows from running sums. One row per source: the windows are small.
    """
    num, den = share
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, rest = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    t = sizes.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * most)
    t = t.withColumns(
        {
            "left": F.sum("source_size").over(everything) * num - F.coalesce(F.sum("cap").over(before), F.lit(0)) * den,
            "wsum": F.sum("w").over(rest),
        }
    )
    # a source is below its cap when sharing the rest among it and all after it stays below
    t = t.withColumn("open", F.col("left") * F.col("w") <= F.col("cap") * F.col("wsum") * den)
    free = F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source", "left", "wsum"))
    t = t.withColumn("at", F.min(free).over(everything))
    level = F.col("w") * F.col("at.left") / (F.col("at.wsum") * F.lit(den)).cast("double")
    return t.select(
        "source",
        "source_size",
        F.when(F.col("open"), level).otherwise(F.col("cap").cast("double")).alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    most: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """One row per row of ``docs``: ``_f, _r`` (see ``keyed``), doc_id, source, size, source_size,
    target, copies, taken. Reruns agree: the offset of a source is a digest of seed and name."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = materialize(keyed(docs, "doc_id", "source", size.alias("size")), "sized")
    # Ranks in a source, without bringing a source to one task: cut the total order into ranges,
    # note the range of each row in a table, count rows per range and source, add them up.
    order = ["source", "size", "doc_id", "_f", "_r"]
    ranged = sized.repartitionByRange(partitions(spark), *order).withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    discard(spark, sized)
    counts = ranged.groupBy("source", "range").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    counts = materialize(counts, "counts")
    sums = counts.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sums, weights, share, most)
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source", "range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    facts = starts.alias("s").join(targets.alias("t"), F.expr("s.source <=> t.source")).select("s.*", "source_size", "target")
    rank = F.row_number().over(Window.partitionBy("source", "range").orderBy(*order[1:])) + F.col("ahead")
    # one row per range and source: as many as partitions and sources, far fewer than documents
    rows = ranged.alias("r").join(facts.alias("f"), F.expr("r.source <=> f.source and r.range = f.range"))
    rows = rows.select("r.*", "ahead", "source_size", "target").withColumn("rank", rank)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("\x00"))))
    offset = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rows = rows.withColumn("each", each).withColumn("offset", offset)
    copies = F.floor(F.expr("rank * each + offset")) - F.floor(F.expr("(rank - 1) * each + offset"))
    rows = rows.withColumn("copies", copies.cast("long"))
    return rows.select(
        "_f", "_r", "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``mixed`` takes it."""
    takes = mixed.where("copies > 0").select("_f", "_r", "copies")
    rows = with_keys(docs).join(takes, ["_f", "_r"])
    return rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), named AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w,
    2 * source_size AS cap FROM sums
), ranked AS (
  SELECT *, 3 * sum(source_size) OVER () - 2 * coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wsum, row_number() OVER r AS k
  FROM named WINDOW r AS (ORDER BY cap / w, source ASC NULLS LAST)
), opened AS (
  SELECT *, rest * w <= cap * wsum * 2 AS is_open FROM ranked
), first_open AS (
  SELECT rest AS rest0, wsum AS wsum0 FROM opened WHERE is_open ORDER BY k LIMIT 1
), targets AS (
  SELECT source, source_size,
    CASE WHEN is_open THEN (w * rest0)::DOUBLE / (wsum0 * 2)::DOUBLE ELSE cap::DOUBLE END AS target
  FROM opened LEFT JOIN first_open ON true
), rows AS (
  SELECT s.doc_id, s.size, s.source, t.source_size, t.target,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) AS rank,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS each,
    ('0x' || substr(md5('mix:' || coalesce(s.source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, (floor(rank * each + off) - floor((rank - 1) * each + off))::BIGINT AS copies FROM rows
)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM taken
"""
