"""Connected components of links between documents, without bringing links to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: A key that more than one in so many rows hold is met by broadcast: there are fewer such keys than this.
SHARE = 1000
#: A key of fewer rows than this is left to the shuffle.
LEAST = 64


def _often(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The values of ``key`` that very many of the n rows hold."""
    return rows.groupBy(F.col(key).alias("often")).count().where(F.col("count") > max(n // SHARE, LEAST)).select("often")


def _with_label(rows: DataFrame, key: str, labels: DataFrame, often: DataFrame) -> DataFrame:
    """``rows`` with ``found``, the label of the node that ``key`` names. The values in ``often``, fewer than
    ``SHARE``, are sent to all tasks, so the rows that hold them stay where they are."""
    often = F.broadcast(often)
    few = labels.join(often, F.col("node") == F.col("often")).select("often", F.col("label").alias("found"))
    hot = rows.join(F.broadcast(few), F.col(key) == F.col("often")).drop("often")
    cold = rows.join(often, F.col(key) == F.col("often"), "left_anti")
    cold = cold.join(labels.select(F.col("node").alias("at"), F.col("label").alias("found")), F.col(key) == F.col("at")).drop("at")
    return hot.unionByName(cold)


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, label): every node of an edge with the smallest node it can reach.

    In each round a node takes the smallest label among its neighbours', then its label's label, so
    distances halve. Each round's labels are written to the shared folder. Rows per round: two for
    each edge and one for each node; nodes with very many edges and labels of very many nodes are
    aggregated before shuffles and looked up by broadcast.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("src", "dst")
    both = materialize(both.where("src <> dst").distinct(), "edges")
    first = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("label"))
    labels = last = materialize(first.withColumnRenamed("src", "node"), "labels")
    n_nodes = labels.count()
    centres = materialize(_often(both, "src", both.count()), "centres")
    while n_nodes:
        seen = _with_label(both, "src", labels, centres).groupBy("dst").agg(F.min("found").alias("near"))
        near = labels.join(seen, F.col("node") == F.col("dst"))
        near = materialize(near.select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "near")
        up = _with_label(near, "label", near.select("node", "label"), _often(near, "label", n_nodes))
        new = materialize(up.select("node", "old", F.least("label", "found").alias("label")), "labels")
        discard(spark, last, near)
        last, labels = new, new.select("node", "label")
        if not new.where("old <> label").limit(1).count():
            break
    discard(spark, both, centres)
    return labels
