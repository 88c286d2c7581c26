"""Scalar functions whose meaning differs from Spark's own of the same name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """Always a double; NULL where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def modulo(a: Column, b: Column) -> Column:
    """The sign of the dividend; NULL where b is zero."""
    return F.when(b != 0, a % b)


def square_root(x: Column) -> Column:
    """NULL below zero."""
    return F.when(x >= 0, F.sqrt(x))


def natural_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def decimal_log(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def sign(x: Column) -> Column:
    return F.signum(x)


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """1-based; a start below one counts as one and does not shorten the length."""
    return F.substr(s, F.greatest(start, F.lit(1)), length if length is not None else F.length(s))


def concat(*parts: Column) -> Column:
    """Joins what is not NULL."""
    return F.concat_ws("", *parts)


def no_nan(x: Column) -> Column:
    """NaN counts as NULL."""
    return F.when(~F.isnan(x), x)


def as_type(x: Column, kind: str) -> Column:
    """A cast that gives NULL for what can't be read."""
    return x.try_cast({"long": "bigint", "double": "double", "string": "string", "date": "date", "timestamp": "timestamp_ntz"}.get(kind, kind))
