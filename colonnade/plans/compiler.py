"""Plans to DataFrames. The operators written are honoured as written; the planner does the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import HINTS
from ..operators.relational import AGGREGATES
from .grammar import BOOLEAN, COMPARISONS, Node, PlanError, Predicate, parse

_COMPARE = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
}


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def condition(p: Predicate) -> Column:
    if p.symbol in BOOLEAN:
        a, b = condition(p.left), condition(p.right)
        return a & b if p.symbol == "AND" else a | b
    if p.symbol in COMPARISONS:
        return _COMPARE[p.symbol](condition(p.left), condition(p.right))
    return column(p.symbol) if p.is_column else F.lit(int(p.symbol))


def predicate_columns(p: Predicate | None) -> set[str]:
    if p is None:
        return set()
    return ({p.symbol} if p.is_column else set()) | predicate_columns(p.left) | predicate_columns(p.right)


def bounds(p: Predicate) -> tuple[str, int | None, int | None]:
    """(column, low, high), both inclusive, of a predicate that is an equality with a number or a
    conjunction of bounds on one column, in either order of operands. Else an error."""

    def one(q: Predicate) -> tuple[str, int | None, int | None]:
        if q.symbol == "AND":
            c, l1, h1 = one(q.left)
            d, l2, h2 = one(q.right)
            if c != d:
                raise PlanError("bounds on different columns")
            pick = lambda f, *v: f(x for x in v if x is not None) if any(x is not None for x in v) else None
            return c, pick(max, l1, l2), pick(min, h1, h2)
        flipped = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "="}
        a, b, op = q.left, q.right, q.symbol
        if op not in flipped:
            raise PlanError(f"no bound: {op}")
        if a.is_number:
            a, b, op = b, a, flipped[op]
        if not (a.is_column and b.is_number):
            raise PlanError("a bound compares a column with a number")
        v = int(b.symbol)
        return a.symbol, *{"=": (v, v), ">": (v + 1, None), ">=": (v, None), "<": (None, v - 1), "<=": (None, v)}[op]

    return one(p)


class Compiler:
    """tables: name -> DataFrame, or a function that finds it; the session's views by default.
    algorithm: a hint for equality joins (see ``operators.joins``); the planner's choice by default."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | Callable[[str], DataFrame] | None = None, algorithm: str | None = None):
        self.find = tables.__getitem__ if isinstance(tables, dict) else tables or spark.table
        self.hint = HINTS[algorithm] if algorithm else None

    def scan(self, table: str) -> DataFrame:
        try:
            df = self.find(table)
        except KeyError:
            raise PlanError(f"unknown table {table}") from None
        return df.select(*(F.col(c).alias(f"{table}.{c}") for c in df.columns))

    def _input(self, child: Node | None, table: str | None, node: Node) -> DataFrame:
        if child is not None:
            return self.frame(child)
        named = [*node.columns, *sorted(predicate_columns(node.predicate))]
        table = table or (named[0].partition(".")[0] if named else None)  # "$": the table of the columns
        if table is None:
            raise PlanError(f"{node.op} has no input")
        return self.scan(table)

    def frame(self, node: Node) -> DataFrame:
        if node.op == "JOIN":
            left, right = self._input(node.left, node.t1, node), self._input(node.right, node.t2, node)
            plain = node.predicate.symbol == "="
            return left.join(right.hint(self.hint) if self.hint and plain else right, condition(node.predicate))
        if node.op == "AGG":
            op, (c,) = node.t2, node.columns
            value = AGGREGATES[op]
            alias = f"{op.lower()}_{c.partition('.')[2]}"
            if node.left is not None and node.left.op == "GRP":
                group, key = node.left, node.left.columns[0]
                df = self._input(group.left, group.t1, group)
                df = df.groupBy(column(key).alias(key))
            else:
                df = self._input(node.left, node.t1, node)
            return df.agg(value(f"`{c}`").alias(alias))
        df = self._input(node.left, node.t1, node)
        if node.op == "SEL":
            return df.where(condition(node.predicate))
        if node.op == "PRO":
            return df.select(*(column(c) for c in node.columns))
        if node.op == "ORD":
            return df.orderBy(*(column(c) for c in node.columns))
        # a group without an aggregate above it: its keys
        return df.select(column(node.columns[0])).distinct()

    def compile(self, plan: str | Node) -> DataFrame:
        """The plan's rows. Columns lose their table's name where the rest tells them apart."""
        df = self.frame(parse(plan) if isinstance(plan, str) else plan)
        short = [c.rpartition(".")[2] for c in df.columns]
        names = [s if short.count(s) == 1 else c.replace(".", "_") for c, s in zip(df.columns, short, strict=True)]
        return df.toDF(*names)


def run_plan(spark: SparkSession, plan: str, tables=None, algorithm: str | None = None) -> DataFrame:
    return Compiler(spark, tables, algorithm).compile(plan)
