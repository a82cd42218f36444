"""Scan, filter, projection, join, aggregate, sort, limit and distinct, each as DataFrame operations.

Every column has a unique name inside a plan, so self-joins and repeated output names are safe. Operators only declare;
pushdown, pruning, join strategy, build side, spilling and top-k are Spark's. Only large cuts by LIMIT or OFFSET run at once.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.nodes import Node, Slot, sort_column
from ..plans.typed import Typed
from .places import between

#: Most rows of an ordered LIMIT and OFFSET that are left to Spark's top-k, which holds them all in one task.
TOP_ROWS = 100_000


def one_row(spark: SparkSession) -> Node:
    """The source of a SELECT without FROM."""
    return Node("Values: 1 rows", spark.range(1).select(), [])


def scanned(table, alias: str | None, number: int) -> Node:
    keys = [f"t{number}_{i}" for i in range(len(table.columns))]
    frame = table.frame.toDF(*keys)
    qualifier = alias or table.name
    slots = [Slot(qualifier, name, kind, key) for (name, kind, _), key in zip(table.columns, keys, strict=True)]
    return Node(f"Scan: {table.name}", frame, slots, reads={s.key: s.name for s in slots})


def filtered(node: Node, predicate: Typed, parts: list[str]) -> Node:
    """Rows for which ``predicate`` is true. Over a scan, its ``parts`` show there, where Spark pushes them."""
    frame = node.frame.filter(predicate.column)
    if node.reads is not None:
        return Node(node.line, frame, node.slots, node.inputs, node.reads, [*node.pushed, *parts])
    return Node(f"Filter: {predicate.text}", frame, node.slots, [node])


def projected(node: Node, items: list[tuple[Typed, str]], number: int) -> Node:
    keys = [f"p{number}_{i}" for i in range(len(items))]
    frame = node.frame.select(*(e.column.alias(k) for (e, _), k in zip(items, keys, strict=True)))
    slots = [Slot(None, name, e.kind, k) for (e, name), k in zip(items, keys, strict=True)]
    return Node(_projection_line(items), frame, slots, [node])


def _projection_line(items: list[tuple[Typed, str]]) -> str:
    return "Projection: " + ", ".join(e.text if e.output_name == n else f"{e.text} AS {n}" for e, n in items)


HOW = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full"}


def joined(kind: str, left: Node, right: Node, on: Typed | None, texts: tuple[list[str], list[str]]) -> Node:
    """The whole ON clause decides on matches before any padding. Without one, it is the product of both sides."""
    if kind == "CROSS":
        frame = left.frame.crossJoin(right.frame)
        if on is not None:
            frame = frame.filter(on.column)
    else:
        frame = left.frame.join(right.frame, on.column, HOW[kind])
    keys, rest = texts
    line = f"{kind} Join" + (f": on {' AND '.join(keys)}" if keys else "")
    line += f", filter {' AND '.join(rest)}" if rest else ""
    return Node(line, frame, left.slots + right.slots, [left, right])


def grouped(node: Node, groups: list[Typed], names: list[str], aggregates, slots: list[Slot]) -> Node:
    """Groups by expressions; without any, one row over all input, even over none."""
    columns = [column.alias(slot.key) for column, slot, _ in aggregates]
    keys = [g.column.alias(n) for g, n in zip(groups, names, strict=True)]
    if not groups:
        frame = node.frame.agg(*columns)
    elif columns:
        frame = node.frame.groupBy(*keys).agg(*columns)
    else:
        frame = node.frame.select(*keys).distinct()
    texts = ", ".join(text for _, _, text in aggregates)
    line = f"Aggregate: group by [{', '.join(g.text for g in groups)}], {texts}" if groups else f"Aggregate: {texts}"
    return Node(line, frame, slots, [node])


Keys = list[tuple[Typed, bool, bool]]


def _sort_line(keys: Keys) -> str:
    parts = (f"{e.text} {'ASC' if up else 'DESC'} NULLS {'FIRST' if first else 'LAST'}" for e, up, first in keys)
    return "Sort: " + ", ".join(parts)


def sorted_rows(node: Node, keys: Keys) -> Node:
    frame = node.frame.orderBy(*(sort_column(e.column, up, first) for e, up, first in keys))
    return Node(_sort_line(keys), frame, node.slots, [node])


def limited(node: Node, limit: int | None, offset: int, ordered: bool) -> Node:
    """Rows from ``offset`` on, ``limit`` at most. The frame, which EXPLAIN shows, is Spark's own.

    Spark brings the first ``offset`` and ``limit`` rows to one task, and without a limit all rows. Few are sorted there,
    and unordered ones pass through; else the rows are cut by stored places when the query is run.
    """
    frame = node.frame.offset(offset) if offset else node.frame
    line = f"Offset: {offset}"
    if limit is not None:
        frame, line = frame.limit(limit), f"Limit: {limit}" + (f", offset {offset}" if offset else "")
    if limit == 0 or limit is not None and (not ordered or offset + limit <= TOP_ROWS):
        return Node(line, frame, node.slots, [node])
    end = None if limit is None else offset + limit
    cut = partial(between, node.frame, offset, end, ordered)
    return Node(f"{line}, by stored places", frame, node.slots, [node], run=cut)


def distinct_rows(projection: Node, items: list[tuple[Typed, str]], keys: Keys) -> Node:
    """Different rows; every sort key is one of the items, so they are sorted afterwards."""
    frame = projection.frame.distinct()
    below = projection
    if keys:
        place = {e.text: slot.key for (e, _), slot in zip(items, projection.slots, strict=True)}
        frame = frame.orderBy(*(sort_column(F.col(place[e.text]), up, first) for e, up, first in keys))
        below = Node(projection.line, frame, projection.slots, [Node(_sort_line(keys), frame, [], projection.inputs)])
    return Node("Distinct", frame, projection.slots, [below])


def distinct_in_order(node: Node, items: list[tuple[Typed, str]], keys: Keys, number: int) -> Node:
    """Different rows in the order of keys that aren't selected: each where its first copy would stand.

    The first copy is found within the copies of each row, so the work is spread by row and no task sees all of them.
    """
    out = [f"p{number}_{i}" for i in range(len(items))]
    by = [f"k{number}_{i}" for i in range(len(keys))]
    columns = [e.column.alias(k) for (e, _), k in zip(items, out, strict=True)]
    columns += [e.column.alias(k) for (e, _, _), k in zip(keys, by, strict=True)]
    order = [sort_column(F.col(k), up, first) for k, (_, up, first) in zip(by, keys, strict=True)]
    rank = f"r{number}"
    wide: DataFrame = node.frame.select(*columns)
    first = wide.withColumn(rank, F.row_number().over(Window.partitionBy(*out).orderBy(*order))).filter(F.col(rank) == 1)
    frame = first.orderBy(*order).select(*out)
    slots = [Slot(None, name, e.kind, k) for (e, name), k in zip(items, out, strict=True)]
    below = Node(_projection_line(items), frame, slots, [Node(_sort_line(keys), frame, [], [node])])
    return Node("Distinct", frame, slots, [below])
