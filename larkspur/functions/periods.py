"""Predicates on half-open periods [from, to)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

PREDICATES: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "overlaps": lambda a, b, c, d: (a < d) & (c < b),
    "equals_period": lambda a, b, c, d: (a == c) & (b == d),
    "contains_period": lambda a, b, c, d: (a <= c) & (b >= d),
    "precedes": lambda a, b, c, d: b <= c,
    "strictly_precedes": lambda a, b, c, d: b < c,
    "immediately_precedes": lambda a, b, c, d: b == c,
    "succeeds": lambda a, b, c, d: a >= d,
    "strictly_succeeds": lambda a, b, c, d: a > d,
    "immediately_succeeds": lambda a, b, c, d: a == d,
    "meets": lambda a, b, c, d: b == c,
}


def period(name: str, a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    return PREDICATES[name.lower()](a_from, a_to, b_from, b_to)
