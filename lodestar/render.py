"""Rows as a bordered table for a terminal."""

from __future__ import annotations

from .sqlfront.tree import float_literal

WIDEST = 40


def cell(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    text = float_literal(value) if isinstance(value, float) else str(value)
    return text if len(text) <= WIDEST else text[: WIDEST - 1] + "…"


def counted(n: int) -> str:
    return f"{n} row{'' if n == 1 else 's'}"


def table(names: list[str], rows: list[tuple]) -> str:
    if not names:
        return f"({len(rows)} rows, no columns)\n"
    grid = [names, *([cell(v) for v in r] for r in rows)]
    widths = [max(len(line[i]) for line in grid) for i in range(len(names))]
    rule = lambda a, b, c: a + b.join("─" * (w + 2) for w in widths) + c + "\n"
    lines = ["│" + "│".join(f" {v:<{w}} " for v, w in zip(line, widths, strict=True)) + "│\n" for line in grid]
    return rule("┌", "┬", "┐") + lines[0] + rule("├", "┼", "┤") + "".join(lines[1:]) + rule("└", "┴", "┘") + counted(len(rows)) + "\n"
