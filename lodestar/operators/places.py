"""LIMIT and OFFSET by stored places, where Spark's own operators would bring too many rows to one task.

The rows are written once, in order and with their places, so what is counted is what is returned: a second run of the
same plan could deal rows out differently, or add floats in another order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.csvio import scratch

#: A place is the number of a part, shifted by these bits, plus the row's number in it, as Spark's increasing ids are made.
ROW_BITS = 33
PLACE = "place"


def between(frame: DataFrame, first: int, end: int | None, ordered: bool) -> DataFrame:
    """Rows ``first`` to ``end`` (not included; None: all) of a frame, counted from 0, in its order if it is ``ordered``.

    Parts are ranges of the order, so places rise through all of them. One row per part reaches the driver.
    """
    spark, where = frame.sparkSession, scratch(frame.sparkSession)
    numbered = frame.withColumn(PLACE, F.monotonically_increasing_id())
    numbered.write.parquet(where)
    stored = spark.read.schema(numbered.schema).parquet(where)
    sizes = sorted(map(tuple, stored.groupBy(F.shiftright(PLACE, ROW_BITS)).count().collect()))
    begin = _place(sizes, first)
    rows = stored.filter(F.col(PLACE) >= begin if begin is not None else F.lit(False))
    stop = _place(sizes, end) if end is not None else None
    if stop is not None:
        rows = rows.filter(F.col(PLACE) < stop)
    return (rows.orderBy(PLACE) if ordered else rows).drop(PLACE)


def _place(sizes: list[tuple[int, int]], row: int) -> int | None:
    """The place of a row by its number from 0, or None past the last."""
    for part, size in sizes:
        if row < size:
            return (part << ROW_BITS) + row
        row -= size
    return None
