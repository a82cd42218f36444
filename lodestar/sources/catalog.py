"""Registered tables, by case-insensitive name."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError
from ..types import Kind, adapted

#: name, type, nullable
ColumnInfo = tuple[str, Kind, bool]


@dataclass
class Table:
    """A table in memory (rows that were inserted, and frames that were loaded) or of a file at ``path``."""

    name: str
    columns: list[ColumnInfo]
    frames: list[DataFrame] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    path: str | None = None
    spark: SparkSession | None = None

    @property
    def schema(self) -> T.StructType:
        # NOT NULL is recorded but not enforced, so Spark must not rely on it.
        kinds = {Kind.BOOLEAN: T.BooleanType, Kind.INT64: T.LongType, Kind.FLOAT64: T.DoubleType, Kind.UTF8: T.StringType}
        return T.StructType([T.StructField(f"c{i}", kinds[k](), True) for i, (_, k, _) in enumerate(self.columns)])

    @property
    def frame(self) -> DataFrame:
        """All rows, with columns c0, c1, ..."""
        parts = list(self.frames)
        if self.rows or not parts:
            parts.append(self.spark.createDataFrame(self.rows, self.schema))
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return out

    def count(self) -> int:
        return self.frame.count()

    def statistics(self) -> list[tuple]:
        """(min, max, nulls, about how many different values) of every column, in one pass."""
        frame = self.frame
        aggregates = []
        for i in range(len(self.columns)):
            c = F.col(f"c{i}")
            aggregates += [F.min(c), F.max(c), F.count_if(c.isNull()), F.approx_count_distinct(c)]
        values = list(frame.agg(*aggregates).first()) if aggregates else []
        return [tuple(values[i : i + 4]) for i in range(0, len(values), 4)]


def from_frame(spark: SparkSession, name: str, df: DataFrame, path: str | None = None) -> Table:
    """A table over any Spark frame; columns outside the four types are left out."""
    kept = [(f, adapted(f)) for f in df.schema.fields]
    kept = [(f, a) for f, a in kept if a is not None]
    frame = df.select(*(column.alias(f"c{i}") for i, (_, (_, column)) in enumerate(kept)))
    columns = [(f.name, kind, f.nullable) for f, (kind, _) in kept]
    return Table(name, columns, [frame], path=path, spark=spark)


class Catalog:
    def __init__(self):
        self._tables: dict[str, Table] = {}

    def get(self, name: str) -> Table:
        table = self._tables.get(name.lower())
        if table is None:
            raise PlanError(f"unknown table `{name}`")
        return table

    def add(self, table: Table, replace: bool = False) -> None:
        if table.name.lower() in self._tables and not replace:
            raise PlanError(f"table `{table.name}` already exists")
        self._tables[table.name.lower()] = table

    def drop(self, name: str) -> None:
        self.get(name)
        del self._tables[name.lower()]

    def names(self) -> list[str]:
        return sorted(t.name for t in self._tables.values())

    def tables(self) -> list[Table]:
        return [self.get(n) for n in self.names()]
