"""Dates and timestamps (TIMESTAMP_NTZ, microseconds)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds of each unit that has a fixed length.
UNITS = {
    "microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000,
    "day": 86_400_000_000, "week": 604_800_000_000,
}


def _unit(unit: str) -> str:
    unit = unit.lower()
    return unit[:-1] if unit.endswith("s") else unit


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, of a date or a timestamp without zone."""
    return F.unix_micros(ts.cast("timestamp_ntz").cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def date_trunc(unit: str, ts: Column) -> Column:
    unit = _unit(unit)
    year = F.year(ts)
    if unit in ("decade", "century", "millennium"):
        span = {"decade": 10, "century": 100, "millennium": 1000}[unit]
        # Decades start in years that end in 0, centuries and millennia in years that end in 1.
        first = year - year % span if unit == "decade" else year - (year - 1) % span
        return F.make_date(first, F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def extract(field: str, ts: Column) -> Column:
    """An integer (bigint). Sunday is day of week 0 and ISO day 7; sub-seconds count from the minute's second."""
    field = _unit(field)
    year = F.year(ts)
    parts = {
        "year": lambda: year, "month": lambda: F.month(ts), "day": lambda: F.dayofmonth(ts), "hour": lambda: F.hour(ts),
        "minute": lambda: F.minute(ts), "second": lambda: F.second(ts), "dow": lambda: F.dayofweek(ts) - 1, "isodow": lambda: F.weekday(ts) + 1,
        "week": lambda: F.weekofyear(ts), "isoweek": lambda: F.weekofyear(ts), "weekofyear": lambda: F.weekofyear(ts), "quarter": lambda: F.quarter(ts),
        "decade": lambda: F.floor(year / 10), "century": lambda: F.floor((year - 1) / 100) + 1, "millennium": lambda: F.floor((year - 1) / 1000) + 1,
        "microsecond": lambda: F.pmod(micros(ts), F.lit(60_000_000)), "millisecond": lambda: F.floor(F.pmod(micros(ts), F.lit(60_000_000)) / 1000),
        "nanosecond": lambda: F.pmod(micros(ts), F.lit(60_000_000)) * 1000, "doy": lambda: F.dayofyear(ts),
    }
    return parts[field]().cast("bigint")


def date_add(unit: str, n, ts: Column) -> Column:
    """Months and years clamp the day to the month's last."""
    n = n if isinstance(n, Column) else F.lit(n)
    unit = _unit(unit)
    if unit in UNITS:
        return from_micros(micros(ts) + n.cast("bigint") * UNITS[unit])
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    return ts.cast("timestamp_ntz") + F.make_ym_interval(F.lit(0), (n * months).cast("int"))


def date_diff(unit: str, a: Column, b: Column) -> Column:
    """a - b as a fractional number of units; months are whole ones plus what is left in months of 31 days."""
    if span := {"month": 1, "quarter": 3, "year": 12}.get(_unit(unit)):
        whole = (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)
        inside = lambda x: micros(x) - micros(F.date_trunc("month", x))
        return (whole + (inside(a) - inside(b)) / F.lit(31.0 * UNITS["day"])) / F.lit(float(span))
    return (micros(a) - micros(b)) / F.lit(float(UNITS[_unit(unit)]))


def time_bucket(width: int, unit: str, ts: Column, origin: Column | None = None) -> Column:
    """The start of the bucket that holds ts; buckets are counted from the epoch or an origin."""
    unit = _unit(unit)
    if unit in ("month", "quarter", "year"):
        width *= {"month": 1, "quarter": 3, "year": 12}[unit]
        base = F.lit(0) if origin is None else (F.year(origin) - 1970) * 12 + F.month(origin) - 1
        month = (F.year(ts) - 1970) * 12 + F.month(ts) - 1
        start = base + F.floor((month - base) / width) * width
        return F.make_date((F.lit(1970) + F.floor(start / 12)).cast("int"), (F.pmod(start, F.lit(12)) + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")
    size = width * UNITS[unit]
    base = F.lit(0) if origin is None else micros(origin)
    return from_micros(base + F.floor((micros(ts) - base) / size) * size)


def epoch_days(ts: Column) -> Column:
    return F.unix_date(ts.cast("date")).cast("bigint")


def epoch_seconds(ts: Column) -> Column:
    return F.floor(micros(ts) / 1_000_000)
