"""Plan nodes: one line each for EXPLAIN, and the DataFrame that Spark runs for them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from ..types import Kind


@dataclass(frozen=True)
class Slot:
    """A column of a node's output: who may name it, its name, type, and the unique name it has in the DataFrame."""

    qualifier: str | None
    name: str
    kind: Kind
    key: str


@dataclass
class Node:
    line: str
    frame: DataFrame
    slots: list[Slot]
    inputs: list[Node] = field(default_factory=list)
    #: Scans only: unique name to column, so that EXPLAIN can list what is read.
    reads: dict[str, str] | None = None
    pushed: list[str] = field(default_factory=list)
    #: Large cuts only: runs what is below and gives a frame of the same rows, to be used in place of ``frame``.
    run: Callable[[], DataFrame] | None = None

    def rows(self) -> DataFrame:
        return self.run() if self.run is not None else self.frame

    def explain(self, used: set[str] | None = None, depth: int = 0) -> str:
        line = self.line
        if self.reads is not None:
            names = [name for key, name in self.reads.items() if used is None or key in used]
            line += f" [{', '.join(names or list(self.reads.values())[:1])}]" if used is not None else " [*]"
            if self.pushed:
                line += ", pushed: " + " AND ".join(self.pushed)
        text = "  " * depth + line + "\n"
        return text + "".join(i.explain(used, depth + 1) for i in self.inputs)


def sort_column(column: Column, ascending: bool, nulls_first: bool) -> Column:
    if ascending:
        return column.asc_nulls_first() if nulls_first else column.asc_nulls_last()
    return column.desc_nulls_first() if nulls_first else column.desc_nulls_last()
