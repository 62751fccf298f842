"""The twelve query templates as plan strings."""

from __future__ import annotations

from .grammar import both, compare, node


def between(column: str, low: int, high: int) -> str:
    """Strictly between."""
    return both(compare(">", column, low), compare("<", column, high))


def point_selection(key: int) -> str:
    sel = node("SEL", "R", columns=("R.a00",), predicate=compare("=", "R.a00", key))
    return node("PRO", "R", columns=("R.a00",), left=sel)


def range_selection(low: int, high: int) -> str:
    sel = node("SEL", "R", columns=("R.a00",), predicate=between("R.a00", low, high))
    return node("PRO", "R", columns=("R.a00",), left=sel)


def aggregate(op: str = "MAX") -> str:
    return node("AGG", "R", op, ("R.a00",))


def order_by(op: str = "MAX") -> str:
    return node("AGG", "R", op, ("R.a00",), left=node("ORD", "R", columns=("R.a00",)))


def group_by(op: str = "MAX") -> str:
    return node("AGG", "R", op, ("R.a00",), left=node("GRP", "R", columns=("R.b00",)))


def nested_loop_join(r: tuple[int, int], s: tuple[int, int]) -> str:
    left = node("SEL", "R", columns=("R.a00",), predicate=between("R.a00", *r))
    right = node("SEL", "S", columns=("S.a00",), predicate=between("S.a00", *s))
    join = node("JOIN", "R", "S", ("R.a00", "S.a00"), compare("<", "R.a00", "S.a00"), left, right)
    return node("PRO", "R", columns=("R.a00",), left=join)


def equi_join() -> str:
    join = node("JOIN", "R", "S", ("R.a00", "S.a00"), compare("=", "R.a00", "S.a00"))
    return node("PRO", "R", columns=("R.a00",), left=join)


def benchmark_1(low: int, width: int) -> str:
    sel = node("SEL", "T1", columns=("T1.a2",), predicate=between("T1.a2", low, low + width))
    return node("PRO", "T1", columns=("T1.a3",), left=sel)


def benchmark_2(low: int, width: int) -> str:
    sel = node("SEL", "T1", columns=("T1.a2",), predicate=between("T1.a2", low, low + width))
    join = node("JOIN", "T1", "T2", ("T1.a1", "T2.a1"), compare("=", "T1.a1", "T2.a1"), sel)
    return node("AGG", "T1", "AVG", ("T1.a3",), left=join)


def benchmark_3(low: int, width: int) -> str:
    sel = node("SEL", "T1", columns=("T1.a2",), predicate=between("T1.a2", low, low + width))
    return node("AGG", "T1", "AVG", ("T1.a3",), left=sel)
