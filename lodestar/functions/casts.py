"""Strict casts: a text that isn't wholly a value of the target type is an error, never NULL or a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import TypeMismatch
from ..types import Kind

INTEGER = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?((inf|infinity|nan)|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"


#: White space of any script, as Java writes it.
BLANKS = r"(?U)^\s+|\s+\z"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end; Spark's own trim takes spaces alone."""
    return F.regexp_replace(text, BLANKS, "")


def _fail(text: Column, kind: Kind, where: str = "") -> Column:
    return F.raise_error(F.concat(F.lit("type error: cannot cast '"), text, F.lit(f"' to {kind}{where}")))


def _parsed(text: Column, kind: Kind, where: str = "") -> Column:
    bare = trimmed(text)
    if kind is Kind.BOOLEAN:
        low = F.lower(bare)
        return (
            F.when(text.isNull(), F.lit(None).cast("boolean"))
            .when(low.isin("true", "t", "1"), F.lit(True))
            .when(low.isin("false", "f", "0"), F.lit(False))
            .otherwise(_fail(text, kind, where).cast("boolean"))
        )
    value = bare.try_cast(kind.value)
    shaped = F.lower(bare).rlike(INTEGER if kind is Kind.INT64 else FLOAT)
    return (
        F.when(text.isNull(), F.lit(None).cast(kind.value))
        .when(shaped & value.isNotNull(), value)
        .otherwise(_fail(text, kind, where).cast(kind.value))
    )


def float_text(x: Column) -> Column:
    """A float in plain digits: ``x.0`` for whole numbers below 1e15, the shortest form without exponent otherwise.

    Spark writes large and small ones as d.ddE±n; the digits are then laid out around the point by that exponent.
    """
    plain = x.cast("string")
    part = lambda k: F.regexp_extract(plain, r"^(-?)(\d)\.(\d+)E(-?\d+)$", k)
    digits = F.concat(part(2), F.regexp_replace(part(3), "0+$", ""))
    power, zero = part(4).cast("int"), F.lit("0")
    large = F.when(F.length(digits) <= power + 1, F.rpad(digits, power + 1, zero)).otherwise(
        F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))
    )
    laid_out = F.when(power >= 0, large).otherwise(F.concat(F.lit("0."), F.repeat(zero, -power - 1), digits))
    whole = (x == F.rint(x)) & (F.abs(x) < 1e15)
    return (
        F.when(whole & plain.contains("E"), F.concat(x.cast("bigint").cast("string"), F.lit(".0")))
        .when(plain.contains("E"), F.concat(part(1), laid_out))
        .otherwise(F.regexp_replace(plain, "Infinity", "inf"))
    )


def strict_cast(column: Column, source: Kind, target: Kind, where: str = "") -> Column:
    """``column`` of type ``source`` as ``target``; raises TypeMismatch where the pair has no cast. ``where`` ends the error
    that a text which isn't a value raises."""
    if source is target:
        return column
    if {source, target} == {Kind.BOOLEAN, Kind.FLOAT64}:
        raise TypeMismatch(f"cannot cast {source} to {target}")
    if target is Kind.UTF8:
        return float_text(column) if source is Kind.FLOAT64 else column.cast("string")
    if source is Kind.UTF8:
        return _parsed(column, target, where)
    return column.cast(target.value)
