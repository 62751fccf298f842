"""Exact deduplication as a stateful stream.

Rows come as a stream of (digest, stable identifier, content locator). State keyed by digest is
kept on disk (RocksDB, checkpointed to the shared folder) and never expires; per digest it holds
the row with the smallest identifier, where its content is, and how many rows came. A digest that
was seen before is only a hit: the bytes of both rows are then compared in full, and rows whose
bytes differ although digests agree are grouped by their bytes instead.

Texts count as equal when identical after each run of white space is replaced by one space.

Defined cases: a null text counts as empty; a null doc_id sorts after all others, and if all of a
group are null the kept one has null; of rows that repeat with the same doc_id exactly one is
kept, by place in the files; an empty table gives an empty result; other columns are not read, whatever
their names (a frame that has a column ``_metadata`` or is no plain file scan is written first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, keyed, materialize, scratch, with_keys

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FILES = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"

#: Rows compared against one replica of a kept text; a larger group gets more replicas.
PER_REPLICA = 512


def normalized(text: Column | str) -> Column:
    """Each run of white space as one space; single spaces, the common case, are left alone."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def first_seen(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Feed a stream of (digest, doc_id, _f, _r) to the keyed state until it has no more rows, and
    log each digest's state after every batch that touched it below ``out``. Calling it again with
    the same checkpoint continues with files that came since."""
    spark = stream.sparkSession
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_f", "_r")
    state = stream.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))

    def log(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    conf = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # else every partition's store sets 4 MB aside on disk, however little it holds
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    }
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getScheme() == "file":
        # a mounted folder renames in one step by itself; the usual manager runs a program (readlink) for each file it renames
        conf["spark.sql.streaming.checkpointFileManagerClass"] = FILES
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:  # the query takes its settings when it starts
        run = state.writeStream.outputMode("update").foreachBatch(log).trigger(availableNow=True)
        run = run.option("checkpointLocation", checkpoint).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    run.awaitTermination()


def states(spark: SparkSession, out: str) -> DataFrame:
    """(digest, first, n): the latest logged state of each digest."""
    schema = "digest binary, first struct<no_id: boolean, doc_id: bigint, _f: bigint, _r: bigint>, n bigint, batch bigint"
    log = spark.read.schema(schema).parquet(out)
    last = log.groupBy("digest").agg(F.max_by(F.struct("first", "n"), "batch").alias("s"))
    return last.select("digest", "s.first", "s.n")


def exact_dedup(docs: DataFrame, digest=sha256) -> DataFrame:
    """One row per row of ``docs``: _f, _r, doc_id, keep_id, group_size, kept, digest."""
    spark = docs.sparkSession
    rows = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), normalized("text").alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    spool, out, checkpoint = (scratch(spark, x) for x in ("digests", "states", "stream"))
    source = rows.drop("text")
    source.write.mode("overwrite").parquet(spool)
    first_seen(spark.readStream.schema(source.schema).parquet(spool), out, checkpoint)
    seen = materialize(states(spark, out), "seen")
    discard(spark, spool, out, checkpoint)  # one call's stream has come to its end

    # Each row meets the state of its digest; only hits keep their bytes. Hot digests are on the
    # side that adaptive execution can split, the state has one row for each.
    is_first = (F.col("_f") == F.col("first._f")) & (F.col("_r") == F.col("first._r"))
    met = rows.join(seen, "digest").withColumn("is_first", is_first)
    met = met.withColumn("text", F.when(F.col("n") > 1, F.col("text")))
    met = materialize(met.select("_f", "_r", "doc_id", "digest", "first", "n", "is_first", "text"), "met")
    discard(spark, seen)

    # Full bytes on hits. A kept text is replicated once for so many rows of its group.
    replicas = F.ceil(F.col("n") / PER_REPLICA).cast("int")
    kept = met.where("is_first and n > 1").select(
        "digest", F.explode(F.sequence(F.lit(0), replicas - 1)).alias("salt"), F.col("text").alias("kept_text")
    )
    hits = met.where("not is_first").withColumn("salt", F.pmod(F.xxhash64("_f", "_r"), replicas).cast("int"))
    checked = hits.join(kept, ["digest", "salt"]).withColumn("same", F.col("text") == F.col("kept_text"))
    checked = checked.withColumn("text", F.when(~F.col("same"), F.col("text"))).drop("kept_text", "salt")
    checked = materialize(checked, "checked")

    # Digests that lied: their rows form groups by their bytes.
    other = checked.where("not same")
    lied = materialize(other.groupBy("digest").agg(F.count("*").alias("n_other")), "lied")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_f", "_r")
    by_bytes = materialize(other.groupBy("digest", "text").agg(F.min(order).alias("head"), F.count("*").alias("size")), "by-bytes")
    regrouped = other.join(by_bytes, ["digest", "text"])
    keep = lambda first: (F.col("_f") == F.col(f"{first}._f")) & (F.col("_r") == F.col(f"{first}._r"))
    cols = ["_f", "_r", "doc_id", "keep_id", "group_size", "kept", "digest"]
    regrouped = regrouped.select(
        "_f", "_r", "doc_id", F.col("head.doc_id").alias("keep_id"), F.col("size").alias("group_size"),
        keep("head").alias("kept"), "digest",
    )
    agreed = met.where("is_first").drop("text").unionByName(checked.where("same").drop("same", "text"))
    agreed = agreed.join(lied, "digest", "left")
    size = F.col("n") - F.coalesce("n_other", F.lit(0))
    agreed = agreed.withColumns({"keep_id": F.col("first.doc_id"), "group_size": size, "kept": F.col("is_first")})
    return agreed.select(cols).unionByName(regrouped.select(cols))


def kept_rows(docs: DataFrame, result: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps."""
    keep = result.where("kept").select("_f", "_r")
    return with_keys(docs).join(keep, ["_f", "_r"], "left_semi").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    result = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return result.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM texts WINDOW g AS (PARTITION BY text)
"""
