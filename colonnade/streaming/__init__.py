"""Running aggregates over streams of rows, with the same meaning as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.relational import AGGREGATES


def running_group_aggregate(stream: DataFrame, key: str, op: str, column: str, alias: str | None = None) -> DataFrame:
    """A grouped aggregate that grows with the stream; write it in complete or update mode."""
    return stream.groupBy(key).agg(AGGREGATES[op](column).alias(alias or f"{op.lower()}_{column}"))
