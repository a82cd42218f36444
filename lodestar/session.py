"""The engine's entry: a catalog and the statements that run against it.

>>> session = Session(spark)
>>> session.attach("orders", "/data/orders.parquet")
>>> session.query("SELECT region, sum(amount) AS total FROM orders GROUP BY region").show()
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .errors import ExecutionError, PlanError, StorageError
from .functions.casts import strict_cast
from .plans.binder import Binder, schema_of
from .plans.nodes import Node
from .plans.typed import literal
from .sources import csvio
from .sources.catalog import Catalog, Table, from_frame
from .sqlfront import tree as t
from .sqlfront.parser import parse, parse_one
from .types import Kind

#: Arithmetic wraps and divides by zero to NULL; Spark notes these settings in a frame when it is built.
SETTINGS = {"spark.sql.ansi.enabled": "false", "spark.sql.cbo.enabled": "true", "spark.sql.cbo.joinReorder.enabled": "true"}


@contextmanager
def dialect(spark: SparkSession) -> Iterator[None]:
    """The dialect's settings while frames are built; the session's own come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@dataclass
class Output:
    """What a statement gives: rows (with the names of their columns), a plan's text, or a message."""

    frame: DataFrame | None = None
    kinds: list[Kind] | None = None
    plan: str | None = None
    message: str | None = None


class Session:
    def __init__(self, spark: SparkSession):
        self.spark, self.catalog = spark, Catalog()

    # Queries

    def _plan(self, q: t.Select) -> tuple[Node, Binder]:
        binder = Binder(self.spark, self.catalog)
        return binder.query(q), binder

    def _rows(self, q: t.Select) -> Output:
        with dialect(self.spark):
            node, _ = self._plan(q)
            frame = node.rows()
            frame = frame.toDF(*(s.name for s in node.slots)) if node.slots else frame
        return Output(frame, [s.kind for s in node.slots])

    def query(self, sql: str) -> DataFrame:
        """The rows of one SELECT. OFFSET without LIMIT, and a large LIMIT with ORDER BY, store rows before this returns."""
        q = parse_one(sql)
        if not isinstance(q, t.Select):
            raise PlanError("query() takes a SELECT")
        return self._rows(q).frame

    def explain(self, sql: str) -> str:
        """The plan of one SELECT: its own tree, then what Catalyst made of it."""
        q = parse_one(sql)
        q = q.query if isinstance(q, t.Explain) else q
        if not isinstance(q, t.Select):
            raise PlanError("only a SELECT has a plan")
        with dialect(self.spark):
            node, binder = self._plan(q)
            tree = node.explain(binder.used)
            return tree + "\nOptimised by Spark:\n" + node.frame._jdf.queryExecution().optimizedPlan().toString()

    def explain_analyze(self, q: t.Select) -> str:
        from .plans.metrics import ran

        with dialect(self.spark):
            frame = self._plan(q)[0].rows()
            # The frame's own plan runs, so that its counters fill, and its rows are counted where they are.
            rows = frame._jdf.queryExecution().toRdd().count()
            return ran(frame) + f"{rows} row{'' if rows == 1 else 's'} returned\n"

    # Statements

    def execute(self, sql: str) -> list[Output]:
        return [self.run(s) for s in parse(sql)]

    def execute_one(self, sql: str) -> Output:
        return self.run(parse_one(sql))

    def run(self, s: t.Statement) -> Output:
        if isinstance(s, t.Select):
            return self._rows(s)
        if isinstance(s, t.Explain):
            if s.analyze:
                return Output(plan=self.explain_analyze(s.query))
            with dialect(self.spark):
                node, binder = self._plan(s.query)
                return Output(plan=node.explain(binder.used))
        if isinstance(s, t.CreateTable):
            self.catalog.add(Table(s.name, schema_of(s.columns), spark=self.spark))
            return Output(message=f"created table {s.name}")
        if isinstance(s, t.DropTable):
            self.catalog.drop(s.name)
            return Output(message=f"dropped table {s.name}")
        if isinstance(s, t.Insert):
            return Output(message=f"inserted {self._insert(s)} rows into {s.table}")
        return Output(message=f"copied {self._copy(s)} rows into {s.table}")

    def _memory(self, name: str) -> Table:
        table = self.catalog.get(name)
        if table.path is not None:
            raise StorageError(f"table `{table.name}` is backed by a file and can't be changed")
        return table

    def _insert(self, s: t.Insert) -> int:
        """All rows or none: their constants are evaluated by Spark first, in one job."""
        table = self._memory(s.table)
        with dialect(self.spark):
            binder = Binder(self.spark, self.catalog)
            cells = []
            for row in s.rows:
                if len(row) != len(table.columns):
                    raise PlanError(f"expected {len(table.columns)} values, found {len(row)}")
                for e, (_, kind, _) in zip(row, table.columns, strict=True):
                    bound = binder.scalar(e, [])
                    column = literal(None).column.cast(kind.value) if bound.null else strict_cast(bound.column, bound.kind, kind)
                    cells.append(column.alias(f"v{len(cells)}"))
            try:
                values = list(self.spark.range(1).select(*cells).first()) if cells else []
            except Exception as e:
                raise ExecutionError(str(e).splitlines()[0]) from e
        width = len(table.columns)
        table.rows += [tuple(values[i : i + width]) for i in range(0, len(values), width)]
        return len(s.rows)

    def _copy(self, s: t.Copy) -> int:
        table = self._memory(s.table)
        header, rows = csvio.sample(self.spark, s.path)
        if len(header) != len(table.columns):
            raise StorageError(f"{s.path} has {len(header)} columns, `{table.name}` has {len(table.columns)}")
        csvio.checked(table.columns, rows)
        with dialect(self.spark):
            frame = csvio.loaded(self.spark, s.path, table.columns)
        table.frames.append(frame)
        return frame.count()

    # Tables

    def import_csv(self, name: str, path: str) -> int:
        """Load a CSV file into a table, whose types come from its first rows; replaces a table of that name."""
        header, rows = csvio.sample(self.spark, path)
        columns = csvio.inferred(header, rows)
        if len({n.lower() for n, _, _ in columns}) != len(columns):
            raise StorageError(f"{path} names a column twice")
        with dialect(self.spark):
            frame = csvio.loaded(self.spark, path, columns)
        self.catalog.add(Table(name, columns, [frame], spark=self.spark), replace=True)
        return frame.count()

    def save_table(self, name: str, path: str, row_group_size: int = 65_536) -> int:
        """Write a table to Parquet with row groups of at most that many rows, and read it from there from now on.

        What was at ``path`` is replaced once the new files are whole, so a table can be saved to where it is read from.
        """
        if row_group_size < 1:
            raise StorageError("a row group holds at least one row")
        table = self.catalog.get(name)
        named = table.frame.toDF(*(n for n, _, _ in table.columns))
        writer = named.write.option("parquet.block.row.count.limit", row_group_size)
        try:
            fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
            writer.parquet(fresh)
            self._moved(fresh, path)
        except AnalysisException as e:
            raise StorageError(str(e).splitlines()[0]) from e
        saved = from_frame(self.spark, table.name, self.spark.read.parquet(path), path)
        saved.columns = [(n, k, null) for (n, k, null) in table.columns]
        self.catalog.add(saved, replace=True)
        return saved.count()

    def _moved(self, source: str, target: str) -> None:
        """Put the folder ``source`` in the place of whatever ``target`` is."""
        paths = self.spark._jvm.org.apache.hadoop.fs.Path
        to = paths(target)
        files = to.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if files.exists(to):
            files.delete(to, True)
        if not files.rename(paths(source), to):
            raise StorageError(f"cannot move {source} to {target}")

    def attach(self, name: str, path: str) -> int:
        """Register Parquet files under a name; replaces a table of that name. Gives the number of rows."""
        try:
            df = self.spark.read.parquet(path)
        except AnalysisException as e:
            raise StorageError(str(e).splitlines()[0]) from e
        table = from_frame(self.spark, name, df, path)
        self.catalog.add(table, replace=True)
        return df.count()

    def register(self, name: str, df: DataFrame, path: str | None = None) -> None:
        """Register any Spark frame under a name, without reading it."""
        self.catalog.add(from_frame(self.spark, name, df, path), replace=True)

    def tables(self) -> list[Table]:
        return self.catalog.tables()

    @contextmanager
    def unoptimised(self) -> Iterator[None]:
        """Without pruning and pushdown, for the benchmark's comparison."""
        off = {
            "spark.sql.optimizer.excludedRules": ",".join(
                f"org.apache.spark.sql.catalyst.optimizer.{r}"
                for r in ("PushDownPredicates", "ColumnPruning", "ConstantFolding", "BooleanSimplification", "ReorderJoin")
            ),
            "spark.sql.parquet.filterPushdown": "false",
        }
        before = {k: self.spark.conf.get(k, None) for k in off}
        for k, v in off.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


