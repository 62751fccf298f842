"""Tables written between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset (tests, a laptop)
    the warehouse is used, which Spark's own tables share in the same way.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: on a cluster it has to name a folder that all executors share")
    return (base or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/") + "/colonnade"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # deleteOnExit ignores paths that do not exist yet, so the folder is made at once
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts the lineage in a way that survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.mode("overwrite").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(spark: SparkSession, *written: DataFrame | str) -> None:
    """Delete tables that ``materialize`` wrote, or other paths of ``scratch``, that no later plan reads."""
    for x in written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x if isinstance(x, str) else x.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
