"""Number helpers that Spark's own formatting does not give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Splits a double into two halves of at most 26 bits each (2^27 + 1).
_SPLITTER = 134217729.0


def or_zero(col: Column, fallback: Column) -> Column:
    """``col``, or ``fallback`` where it is null *or zero* (both count as missing)."""
    return F.when(F.coalesce(col, F.lit(0)) == 0, fallback).otherwise(col)


def or_empty(col: Column, fallback: Column) -> Column:
    """``col``, or ``fallback`` where it is null *or empty*."""
    return F.when(F.coalesce(col, F.lit("")) == "", fallback).otherwise(col)


def fixed_sql(x: str, digits: int) -> str:
    """SQL for the decimal text of a double, rounded on its exact binary value (half away from zero).

    ``format_string`` rounds the shortest decimal form instead, which turns 0.015 into 0.02 although the
    double lies below 0.015. The comparison with the half-way point is made exact by splitting the double.
    """
    scale = 10**digits
    a = f"abs({x})"
    guess = f"double(floor({a} * {scale}D + 0.5D))"
    high = f"({a} * {_SPLITTER}D - ({a} * {_SPLITTER}D - {a}))"

    def reaches(n: str) -> str:
        return f"({high} * {2 * scale}D - ({n} * 2 - 1)) + ({a} - {high}) * {2 * scale}D >= 0"

    n = (
        f"bigint(CASE WHEN {reaches(f'({guess} + 1)')} THEN {guess} + 1 "
        f"WHEN {reaches(guess)} THEN {guess} ELSE {guess} - 1 END)"
    )
    text = f"string({n})"
    if digits:
        text = f"concat(string({n} div {scale}), '.', lpad(string({n} % {scale}), {digits}, '0'))"
    return f"concat(CASE WHEN {x} < 0 THEN '-' ELSE '' END, {text})"


def to_fixed(x: str, digits: int) -> Column:
    """:func:`fixed_sql` of a column name or SQL expression."""
    return F.expr(fixed_sql(x, digits))


def script_number(x: Column) -> Column:
    """The text of a number as scripts in a browser write it: ``3``, ``0.0000075``, ``7.5e-7``; null is ``null``."""
    text = x.cast("double").cast("string")
    plain = F.regexp_replace(text.cast("decimal(38,23)").cast("string"), r"\.?0+$", "")
    tiny = F.regexp_replace(F.lower(text), r"\.0e", "e")
    return (
        F.when(x.isNull(), F.lit("null"))
        .when(x == 0, F.lit("0"))
        .when((F.abs(x) >= 1e-6) & (F.abs(x) < 1e15), plain)
        .otherwise(tiny)
    )
