"""Records of four integers (x, y, z, w) in one column: taking out and replacing some of the fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("x", "y", "z", "w")


def record(x: Column | str, y: Column | str, z: Column | str, w: Column | str) -> Column:
    return F.struct(*(F.col(c).alias(f) if isinstance(c, str) else c.alias(f) for c, f in zip((x, y, z, w), FIELDS, strict=True)))


def take_fields(column: Column, *fields: str) -> Column:
    """The fields named, in their order, as a smaller record."""
    return F.struct(*(column.getField(f).alias(f) for f in fields))


def put_fields(column: Column, values: dict[str, Column]) -> Column:
    """The record with some fields replaced."""
    for f, v in values.items():
        if f not in FIELDS:
            raise ValueError(f"no field {f}")
        column = column.withField(f, v)
    return column
