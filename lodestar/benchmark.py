"""Seven queries over a generated table in Parquet with small row groups, with and without Spark's pruning."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import Session
from .sources.csvio import scratch

ROW_GROUP = 8192

#: Cases over n rows; a bound in percent of n keeps their selectivity at any size.
CASES = {
    "selective_range": "SELECT id, amount FROM events WHERE id > {p98}",
    "point_lookup": "SELECT label FROM events WHERE id = {point}",
    "narrow_projection": "SELECT sum(amount) AS total FROM events",
    "group_by": "SELECT status, count(*) AS n, sum(amount) AS total FROM events GROUP BY status",
    "filtered_group_by": "SELECT status, count(*) AS n FROM events WHERE amount > 900 GROUP BY status",
    "order_by_limit": "SELECT id, amount FROM events ORDER BY amount DESC, id LIMIT 10",
    "join": "SELECT e.id, s.description FROM events e JOIN statuses s ON e.status = s.name WHERE e.id > {p99}",
}


def cases(n: int) -> dict[str, str]:
    return {k: sql.format(p98=n * 98 // 100, p99=n * 99 // 100, point=n // 4) for k, sql in CASES.items()}


def generated(spark: SparkSession, n: int) -> Session:
    """A session over freshly written tables; only ``events`` grows with ``n``."""
    names = F.array(*(F.lit(s) for s in ("pending", "shipped", "delivered", "cancelled")))
    i = F.col("id")
    events = spark.range(0, n, 1, 1).select(
        i,
        F.get(names, (i % 4).cast("int")).alias("status"),
        F.concat(F.lit("event-"), i.cast("string")).alias("label"),
        F.when(i % 100 != 0, (i % 1000).cast("double")).alias("amount"),
    )
    statuses = spark.range(4).select(F.get(names, i.cast("int")).alias("name"))
    session = Session(spark)
    session.register("events", events)
    session.register("statuses", statuses.withColumn("description", F.concat(F.lit("status: "), "name")))
    for name in ("events", "statuses"):
        session.save_table(name, scratch(spark), ROW_GROUP)
    return session


def seconds(made: Callable[[], DataFrame], runs: int = 3) -> float:
    """The best of some runs to the last row, after one that isn't counted.

    Each run has a frame of its own: one that has run keeps its shuffle files, and would skip those stages.
    """
    best = float("inf")
    for k in range(runs + 1):
        frame = made()
        started = time.perf_counter()
        frame.collect()
        if k:
            best = min(best, time.perf_counter() - started)
    return best


@dataclass
class Groups:
    total: int
    kept: int


def row_groups(path: str, column: str, low: float) -> Groups:
    """Row groups whose footer statistics let ``column > low`` be true: an estimate of what a scan reads."""
    metadata = pq.ParquetDataset(path.removeprefix("file:")).fragments
    total = kept = 0
    for fragment in metadata:
        footer = fragment.metadata
        at = footer.schema.to_arrow_schema().get_field_index(column)
        for g in range(footer.num_row_groups):
            total += 1
            statistics = footer.row_group(g).column(at).statistics
            kept += statistics is None or not statistics.has_min_max or statistics.max > low
    return Groups(total, kept)


def measured(spark: SparkSession, n: int) -> list[tuple[str, float, float, int, bool]]:
    """name, seconds, seconds without pruning, rows, and whether both gave the same values."""
    session = generated(spark, n)
    out = []
    for name, sql in cases(n).items():
        made = partial(session.query, sql)
        fast, rows = seconds(made), made().collect()
        with session.unoptimised():
            slow, other = seconds(made), made().collect()
        out.append((name, fast, slow, len(rows), sorted(map(str, rows)) == sorted(map(str, other))))
    return out


def report(spark: SparkSession, n: int) -> str:
    lines = [f"{'query':<20} {'seconds':>9} {'unpruned':>9} {'ratio':>6} {'rows':>7}  values\n"]
    for name, fast, slow, rows, same in measured(spark, n):
        lines.append(f"{name:<20} {fast:>9.4f} {slow:>9.4f} {slow / fast:>6.1f} {rows:>7}  {'equal' if same else 'DIFFER'}\n")
    return "".join(lines)
