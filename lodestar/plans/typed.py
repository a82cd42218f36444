"""Typed expressions: a Spark column, its type, and the text that EXPLAIN and output names use."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PlanError, TypeMismatch
from ..functions.casts import strict_cast
from ..sqlfront import tree as t
from ..types import Kind, unified

#: LIKE has no escape character; this one never occurs in a pattern.
NO_ESCAPE = "\x01"


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: Kind
    text: str
    name: str | None = None
    null: bool = False
    used: frozenset[str] = frozenset()

    @property
    def output_name(self) -> str:
        return self.name if self.name is not None else self.text

    def to(self, kind: Kind) -> Column:
        return self.column if self.kind is kind else self.column.cast(kind.value)


def literal(value: object) -> Typed:
    kinds = {bool: Kind.BOOLEAN, int: Kind.INT64, float: Kind.FLOAT64, str: Kind.UTF8, type(None): Kind.INT64}
    kind = kinds[type(value)]
    return Typed(F.lit(value).cast(kind.value), kind, t.literal_text(value), null=value is None)


def require_boolean(e: Typed, where: str) -> Typed:
    if e.kind is not Kind.BOOLEAN:
        raise TypeMismatch(f"{where} needs a boolean, found {e.kind}")
    return e


def _used(*parts: Typed) -> frozenset[str]:
    return frozenset().union(*(p.used for p in parts))


def _comparable(left: Typed, right: Typed) -> Kind:
    """The type to compare in; a bare NULL compares with anything."""
    if left.null:
        return right.kind
    if right.null:
        return left.kind
    return unified(left.kind, right.kind)


def compare(op: str, left: Typed, right: Typed) -> Typed:
    kind = _comparable(left, right)
    a, b = left.to(kind), right.to(kind)
    column = {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return Typed(column, Kind.BOOLEAN, f"({left.text} {op} {right.text})", used=_used(left, right))


def infix(op: str, left: Typed, right: Typed) -> Typed:
    text = f"({left.text} {op} {right.text})"
    if op in ("AND", "OR"):
        for side in (left, right):
            require_boolean(side, op)
        column = left.column & right.column if op == "AND" else left.column | right.column
        return Typed(column, Kind.BOOLEAN, text, used=_used(left, right))
    if op in ("=", "<>", "<", "<=", ">", ">="):
        return compare(op, left, right)
    for side in (left, right):
        if not side.kind.numeric:
            raise TypeMismatch(f"`{op}` needs numbers, found {side.kind}")
    kind = Kind.FLOAT64 if op == "/" else unified(left.kind, right.kind)
    a, b = left.to(kind), right.to(kind)
    column = {"+": a + b, "-": a - b, "*": a * b, "/": a / b, "%": a % b}[op]
    return Typed(column, kind, text, used=_used(left, right))


def prefix(op: str, inner: Typed) -> Typed:
    if op == "NOT":
        require_boolean(inner, "NOT")
        return Typed(~inner.column, Kind.BOOLEAN, f"NOT {inner.text}", used=inner.used)
    if not inner.kind.numeric:
        raise TypeMismatch(f"`-` needs a number, found {inner.kind}")
    return Typed(-inner.column, inner.kind, f"-{inner.text}", used=inner.used)


def is_null(inner: Typed, negated: bool) -> Typed:
    column = inner.column.isNotNull() if negated else inner.column.isNull()
    return Typed(column, Kind.BOOLEAN, f"{inner.text} IS {'NOT ' if negated else ''}NULL", used=inner.used)


def among(inner: Typed, items: list[Typed], negated: bool) -> Typed:
    kind = inner.kind
    for item in items:
        if not item.null and not inner.null:
            kind = unified(kind, item.kind)
        elif inner.null and not item.null:
            kind = item.kind
    column = inner.to(kind).isin(*(i.to(kind) for i in items))
    text = f"{inner.text} {'NOT ' if negated else ''}IN ({', '.join(i.text for i in items)})"
    return Typed(~column if negated else column, Kind.BOOLEAN, text, used=_used(inner, *items))


def like(inner: Typed, pattern: Typed, negated: bool) -> Typed:
    for side in (inner, pattern):
        if side.kind is not Kind.UTF8:
            raise TypeMismatch(f"LIKE needs text, found {side.kind}")
    column = F.like(inner.column, pattern.column, F.lit(NO_ESCAPE))
    text = f"{inner.text} {'NOT ' if negated else ''}LIKE {pattern.text}"
    return Typed(~column if negated else column, Kind.BOOLEAN, text, used=_used(inner, pattern))


def case(branches: list[tuple[Typed, Typed]], otherwise: Typed | None) -> Typed:
    results = [then for _, then in branches] + ([otherwise] if otherwise is not None else [])
    kinds = [r.kind for r in results if not r.null]
    kind = reduce(unified, kinds) if kinds else Kind.INT64
    column = None
    for when, then in branches:
        require_boolean(when, "CASE WHEN")
        column = F.when(when.column, then.to(kind)) if column is None else column.when(when.column, then.to(kind))
    if otherwise is not None:
        column = column.otherwise(otherwise.to(kind))
    text = "CASE" + "".join(f" WHEN {w.text} THEN {x.text}" for w, x in branches)
    text += f" ELSE {otherwise.text} END" if otherwise is not None else " END"
    return Typed(column, kind, text, used=_used(*results, *(w for w, _ in branches)))


def cast(inner: Typed, kind: Kind) -> Typed:
    text = f"CAST({inner.text} AS {kind})"
    column = F.lit(None).cast(kind.value) if inner.null else strict_cast(inner.column, inner.kind, kind)
    return Typed(column, kind, text, used=inner.used)


AGGREGATES = ("count", "sum", "min", "max", "avg")


def aggregate(name: str, arg: Typed | None, distinct: bool) -> tuple[Column, Kind]:
    """An aggregate function's column and result type; no argument stands for ``*``."""
    if arg is None:
        if name != "count":
            raise PlanError(f"{name}(*) has no meaning")
        return F.count(F.lit(1)), Kind.INT64
    if name in ("sum", "avg") and not arg.kind.numeric:
        raise TypeMismatch(f"cannot {name} {arg.kind}")
    if name == "count":
        return (F.count_distinct(arg.column) if distinct else F.count(arg.column)), Kind.INT64
    if name == "sum":
        return (F.sum_distinct(arg.column) if distinct else F.sum(arg.column)), arg.kind
    if name == "avg":
        value = arg.column.cast("double")
        # The mean of distinct values is their sum over their number.
        return (F.sum_distinct(value) / F.count_distinct(value) if distinct else F.avg(value)), Kind.FLOAT64
    return (F.min if name == "min" else F.max)(arg.column), arg.kind
