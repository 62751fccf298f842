"""Partition functions as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The multipliers of the byte-wise string hash used to deal out partitions.
RS_A, RS_B = 63689, 378551


def mod_part(value: Column, n: int) -> Column:
    return F.pmod(value, F.lit(n))


def radix_part(value: Column, shift: int, bits: int) -> Column:
    return F.shiftright(value, shift).bitwiseAND((1 << bits) - 1)


def rs_part(value: Column, n: int) -> Column:
    """The byte-wise hash modulo n, a power of two. Only the low bits of each step matter, so no step overflows."""
    if n & (n - 1):
        raise ValueError("the number of partitions must be a power of two")
    h, a = F.lit(0).cast("long"), RS_A
    for i in range(4):
        h = (h * (a % n) + F.shiftright(value.cast("long"), 24 - 8 * i)).bitwiseAND(n - 1)
        a = a * RS_B
    return h


#: A plan holds all pivots.
MOST_PIVOTS = 1024


def pivot_part(value: Column, pivots: list[int]) -> Column:
    """How many of the ascending pivots are not above the value, by halving."""
    if len(pivots) > MOST_PIVOTS:
        raise ValueError(f"more than {MOST_PIVOTS} pivots: split by positions instead")

    def halve(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value < pivots[mid], halve(low, mid)).otherwise(halve(mid + 1, high))

    return halve(0, len(pivots))
