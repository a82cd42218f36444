"""Syntax trees."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal


class Expr:
    """An expression; ``str`` gives the text that names an aggregate's output."""


def literal_text(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return f"'{value}'"
    if isinstance(value, float):
        return float_literal(value)
    return str(value)


def float_literal(x: float) -> str:
    if x != x or x in (float("inf"), float("-inf")):
        return {"nan": "NaN"}.get(str(x), str(x))
    if x == int(x) and abs(x) < 1e15:
        return f"{x:.1f}"
    if x == int(x):
        return str(int(x))
    return f"{Decimal(repr(x)):f}"


@dataclass(frozen=True)
class Literal(Expr):
    value: object

    def __str__(self) -> str:
        return literal_text(self.value)


@dataclass(frozen=True)
class Name(Expr):
    qualifier: str | None
    name: str

    def __str__(self) -> str:
        return f"{self.qualifier}.{self.name}" if self.qualifier else self.name


@dataclass(frozen=True)
class Star(Expr):
    qualifier: str | None = None

    def __str__(self) -> str:
        return f"{self.qualifier}.*" if self.qualifier else "*"


@dataclass(frozen=True)
class Infix(Expr):
    op: str
    left: Expr
    right: Expr

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Prefix(Expr):
    op: str
    inner: Expr

    def __str__(self) -> str:
        return f"NOT {self.inner}" if self.op == "NOT" else f"{self.op}{self.inner}"


@dataclass(frozen=True)
class IsNull(Expr):
    inner: Expr
    negated: bool

    def __str__(self) -> str:
        return f"{self.inner} IS {'NOT ' if self.negated else ''}NULL"


@dataclass(frozen=True)
class Between(Expr):
    inner: Expr
    low: Expr
    high: Expr
    negated: bool

    def __str__(self) -> str:
        return f"{self.inner} {'NOT ' if self.negated else ''}BETWEEN {self.low} AND {self.high}"


@dataclass(frozen=True)
class Among(Expr):
    inner: Expr
    items: tuple[Expr, ...]
    negated: bool

    def __str__(self) -> str:
        return f"{self.inner} {'NOT ' if self.negated else ''}IN ({', '.join(map(str, self.items))})"


@dataclass(frozen=True)
class Like(Expr):
    inner: Expr
    pattern: Expr
    negated: bool

    def __str__(self) -> str:
        return f"{self.inner} {'NOT ' if self.negated else ''}LIKE {self.pattern}"


@dataclass(frozen=True)
class Case(Expr):
    operand: Expr | None
    branches: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None

    def __str__(self) -> str:
        middle = "".join(f" WHEN {w} THEN {t}" for w, t in self.branches)
        start = f"CASE {self.operand}" if self.operand is not None else "CASE"
        return f"{start}{middle}{f' ELSE {self.otherwise}' if self.otherwise is not None else ''} END"


@dataclass(frozen=True)
class Cast(Expr):
    inner: Expr
    type_name: str

    def __str__(self) -> str:
        return f"CAST({self.inner} AS {self.type_name})"


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False

    def __str__(self) -> str:
        return f"{self.name.lower()}({'DISTINCT ' if self.distinct else ''}{', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Source:
    table: str
    alias: str | None = None


@dataclass(frozen=True)
class Joined:
    kind: str
    left: Source | Joined
    right: Source | Joined
    on: Expr | None


@dataclass(frozen=True)
class SortKey:
    expr: Expr
    ascending: bool = True
    nulls_first: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    distinct: bool = False
    source: Source | Joined | None = None
    where: Expr | None = None
    groups: tuple[Expr, ...] = ()
    having: Expr | None = None
    order: tuple[SortKey, ...] = ()
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type_name: str
    nullable: bool = True


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnSpec, ...]


@dataclass(frozen=True)
class Insert:
    table: str
    rows: tuple[tuple[Expr, ...], ...]


@dataclass(frozen=True)
class Copy:
    table: str
    path: str


@dataclass(frozen=True)
class DropTable:
    name: str


@dataclass(frozen=True)
class Explain:
    query: Select
    analyze: bool = False


Statement = Select | CreateTable | Insert | Copy | DropTable | Explain

