"""Connected components over an edge table, by alternating large-star and small-star rounds.

Each round is two group-bys with partial aggregation and two joins; its edges are written to shared storage, so lineage
stays short and nothing but a count and a checksum of the edges reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.filter("b > a").join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), mark).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of every node that has an edge; the label is the least node of its component.

    ``edges`` has two columns a and b of one type that sorts, such as long or a struct of longs; loops and repeated edges
    do no harm. No edges, no rows.
    """
    now = stored(edges.select("a", "b").filter("a <> b").distinct(), name)
    state = _state(now)
    while state[0]:
        then = stored(_small_star(_large_star(now)), name)
        reached = _state(then)
        removed(now.sparkSession, now)
        now = then
        if reached == state:
            break
        state = reached
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return leaves.union(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
