"""Data-parallel primitives and expressions."""
