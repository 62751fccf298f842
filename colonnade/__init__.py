"""Colonnade: a column-algebra query engine expressed as Spark DataFrames."""
