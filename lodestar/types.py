"""The four column types, their names in SQL, and how Spark's types fit into them."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import TypeMismatch


class Kind(Enum):
    BOOLEAN = "boolean"
    INT64 = "bigint"
    FLOAT64 = "double"
    UTF8 = "string"

    def __str__(self) -> str:
        return self.name

    @property
    def numeric(self) -> bool:
        return self in (Kind.INT64, Kind.FLOAT64)


SQL_NAMES = {
    "BOOLEAN": Kind.BOOLEAN,
    "BOOL": Kind.BOOLEAN,
    "INT": Kind.INT64,
    "INTEGER": Kind.INT64,
    "BIGINT": Kind.INT64,
    "FLOAT": Kind.FLOAT64,
    "DOUBLE": Kind.FLOAT64,
    "REAL": Kind.FLOAT64,
    "TEXT": Kind.UTF8,
    "VARCHAR": Kind.UTF8,
    "STRING": Kind.UTF8,
}


def unified(a: Kind, b: Kind) -> Kind:
    """The type both sides of an operation are brought to."""
    if a is b:
        return a
    if a.numeric and b.numeric:
        return Kind.FLOAT64
    raise TypeMismatch(f"{a} and {b} have no common type")


def adapted(field: T.StructField) -> tuple[Kind, Column] | None:
    """A field of any Spark table as one of the four types; None for nested and binary ones, which are left out."""
    column, kind = F.col(f"`{field.name.replace('`', '``')}`"), field.dataType
    if isinstance(kind, T.BooleanType):
        return Kind.BOOLEAN, column
    if isinstance(kind, T.LongType):
        return Kind.INT64, column
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return Kind.INT64, column.cast("bigint")
    if isinstance(kind, T.DoubleType):
        return Kind.FLOAT64, column
    if isinstance(kind, (T.FloatType, T.DecimalType)):
        return Kind.FLOAT64, column.cast("double")
    if isinstance(kind, T.StringType):
        return Kind.UTF8, column
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType, T.CharType, T.VarcharType)):
        return Kind.UTF8, column.cast("string")
    return None
