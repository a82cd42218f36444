"""CSV files: own type inference over a sample, strict cells, and Spark's reader for the rest.

Fields are separated by commas and may be quoted; a doubled quote stands for one; no field spans lines; lines of white space
alone are skipped; cells are trimmed of white space of any kind and blank ones are NULL. Rows with another number of fields
than the header are errors. Rows of the sample are checked on the driver, with their numbers; all others by Spark's reader
when the load runs, which tells the line or the cell and its column.
"""

from __future__ import annotations

import csv
import re
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StorageError
from ..functions.casts import FLOAT, INTEGER, strict_cast, trimmed
from ..types import Kind

SAMPLE = 1000
#: Text with something else than white space of any script.
FILLED = r"(?U)\S"


def _fields(line: str) -> list[str]:
    return [c.strip() for c in next(csv.reader([line]))]


def _lines(spark: SparkSession, path: str, n: int) -> list[str]:
    lines = spark.read.text(path).filter(F.col("value").rlike(FILLED))
    try:
        return [r.value for r in lines.limit(n).collect()]
    except PySparkException as e:
        raise StorageError(f"cannot read {path}: {str(e).splitlines()[0]}") from e


def sample(spark: SparkSession, path: str) -> tuple[list[str], list[list[str]]]:
    """The header's names and the first rows."""
    lines = _lines(spark, path, SAMPLE + 1)
    if not lines:
        raise StorageError(f"{path} is empty")
    header, *rows = map(_fields, lines)
    if not all(header):
        raise StorageError(f"{path} has a column without a name")
    for number, row in enumerate(rows, 2):
        if len(row) != len(header):
            raise StorageError(f"row {number}: expected {len(header)} fields, found {len(row)}")
    return header, rows


def fits(cell: str, kind: Kind) -> bool:
    if kind is Kind.BOOLEAN:
        return cell.lower() in ("true", "false", "t", "f")
    if kind is Kind.INT64:
        return bool(re.match(INTEGER, cell)) and -(1 << 63) <= int(cell) < 1 << 63
    if kind is Kind.FLOAT64:
        return bool(re.match(FLOAT, cell, re.I))
    return True


def inferred(header: list[str], rows: list[list[str]]) -> list[tuple[str, Kind, bool]]:
    """Each column's narrowest type for all of its cells that aren't blank; text if all are."""
    out = []
    for i, name in enumerate(header):
        cells = [r[i] for r in rows]
        filled = [c for c in cells if c]
        order = (Kind.BOOLEAN, Kind.INT64, Kind.FLOAT64, Kind.UTF8)
        kind = next(k for k in order if all(fits(c, k) for c in filled)) if filled else Kind.UTF8
        out.append((name, kind, len(filled) < len(cells)))
    return out


def checked(columns: list[tuple[str, Kind, bool]], rows: list[list[str]]) -> None:
    for number, row in enumerate(rows, 2):
        for (name, kind, _), cell in zip(columns, row, strict=True):
            good = not cell or fits(cell, kind) or kind is Kind.BOOLEAN and cell in "01"
            if not good:
                raise StorageError(f"row {number}, column {name}: cannot cast '{cell}' to {kind}")


def scratch(spark: SparkSession) -> str:
    """A folder in shared storage for a loaded table."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/loaded-{uuid.uuid4().hex}"


def loaded(spark: SparkSession, path: str, columns: list[tuple[str, Kind, bool]]) -> DataFrame:
    """The file's rows by position as columns c0, c1, ...; written once, so that a bad cell fails the load itself."""
    names = [f"c{i}" for i in range(len(columns))]
    raw = spark.read.csv(
        path, header=True, schema=", ".join(f"{n} string" for n in [*names, "line"]), quote='"', escape='"', mode="PERMISSIVE",
        columnNameOfCorruptRecord="line", enforceSchema=True,
    )
    # A line that isn't a row is in ``line``; where there is one column only, one of white space is a row of one cell.
    blank = F.col("line").isNotNull() & ~F.col("line").rlike(FILLED)
    if len(names) == 1:
        blank = blank | F.coalesce((F.col("c0") != "") & ~F.col("c0").rlike(FILLED), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit(f"type error: expected {len(names)} fields in line: "), F.col("line")))
    cells = []
    for n, (name, kind, _) in zip(names, columns, strict=True):
        cell = trimmed(F.when(F.col("line").isNull(), F.col(n)).otherwise(wrong.cast("string")))
        cells.append(strict_cast(F.when(cell != "", cell), Kind.UTF8, kind, f" in column {name}").alias(n))
    where = scratch(spark)
    try:
        raw.filter(~blank).select(*cells).write.parquet(where)
    except PySparkException as e:
        told = re.search(r"type error: [^\n\"]*|Malformed [^\n]*", str(e))
        raise StorageError(f"{path}: {told[0] if told else str(e).splitlines()[0]}") from e
    return spark.read.schema(", ".join(f"{n} {k.value}" for n, (_, k, _) in zip(names, columns, strict=True))).parquet(where)
