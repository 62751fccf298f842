"""The corpus pipeline: five stages, each on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of docs, whatever their names, and
rows as they are; further columns are carried along. An empty table gives an empty result in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm import exact_dedup, language, mixing, near_dedup, pieces
from colonnade.llm.common import discard, documents, materialize

#: A document is rejected if its language is unknown or less likely than this.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters (null and empty ones too) and those of which no language is likely. The
    model learns from the labelled documents that are not held out; where none is labelled, only texts
    without letters go. Rows that repeat are judged each; a null doc_id or lang is no reason to go."""
    model = language.train(docs.where(~language.held_out()))
    if not model.learned:  # nothing to learn from: nothing but texts without letters can be told
        return docs.where(F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"\p{L}")))
    rows = docs.withColumnsRenamed({c: f"c{i}" for i, c in enumerate(docs.columns)})
    rows = rows.withColumn("text", F.col(f"c{docs.columns.index('text')}"))
    found = language.predict(rows, model, *(f"c{i}" for i in range(len(docs.columns))))
    found = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (null counts as empty; a run of white space as one space) the one with the
    smallest doc_id stays, a null doc_id after all others, and of equal ones the first by place in the files."""
    return exact_dedup.kept_rows(docs, exact_dedup.exact_dedup(docs))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays, that with the
    smallest doc_id, with all rows that have it. Texts without words and rows without doc_id are linked with
    nothing and stay."""
    groups = near_dedup.near_duplicates(docs, k=5, percent=80)
    drop = materialize(groups.where("not kept").select(F.col("doc_id").alias("__drop")), "drop")
    return docs.join(drop, docs.doc_id == F.col("__drop"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights: a row comes as often as the mix takes it (0 to 2 times). Null is a source
    of its own, the last one; a source without words is not taken."""
    return mixing.repeated(docs, materialize(mixing.mix(docs), "mixed"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, score, second (the second best path's score) and others (the second to the fourth
    best paths) of every row of the mix. A null or empty text has no piece and one path, with score 0."""
    return pieces.encode_pieces(docs, keep=("source",))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("mixing", mix),
    ("pieces", encode),
]

#: SQL expresses neither a trained model, nor MinHash candidates, nor a search over a lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if last:
            discard(spark, last)
        last = docs
    return docs
