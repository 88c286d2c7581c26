"""Tables with a valid and a system axis: half-open periods of timestamps without zone."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = {"valid": ("_valid_from", "_valid_to"), "system": ("_system_from", "_system_to")}
#: The open end of a period.
END_OF_TIME = dt.datetime(9999, 12, 31, 23, 59, 59, 999999)
START_OF_TIME = dt.datetime(1, 1, 1)


def moment(x, now: dt.datetime | None = None) -> Column:
    """A literal, NOW, END_OF_TIME, START_OF_TIME or a column as a timestamp without zone."""
    if isinstance(x, Column):
        return x.cast("timestamp_ntz")
    if isinstance(x, str):
        named = {"END_OF_TIME": END_OF_TIME, "START_OF_TIME": START_OF_TIME, "NOW": now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)}
        x = named.get(x.upper().rstrip("()"), x)
    return F.lit(str(x)).cast("timestamp_ntz")


def axes(df: DataFrame) -> list[str]:
    return [a for a, (x, _) in AXES.items() if x in df.columns]


def as_of(df: DataFrame, axis: str, t, now=None) -> DataFrame:
    start, end = AXES[axis]
    return df.filter((F.col(start) <= moment(t, now)) & (F.col(end) > moment(t, now)))


def between(df: DataFrame, axis: str, a, b) -> DataFrame:
    """Periods that meet [a, b]."""
    start, end = AXES[axis]
    return df.filter((F.col(start) <= moment(b)) & (F.col(end) > moment(a)))


def from_to(df: DataFrame, axis: str, a, b) -> DataFrame:
    """Periods that meet [a, b)."""
    start, end = AXES[axis]
    return df.filter((F.col(start) < moment(b)) & (F.col(end) > moment(a)))


def append(df: DataFrame, rows: DataFrame, now) -> DataFrame:
    """Add rows; periods that they lack are from now on."""
    for axis in axes(df):
        start, end = AXES[axis]
        if start not in rows.columns:
            rows = rows.withColumn(start, moment(now))
        if end not in rows.columns:
            rows = rows.withColumn(end, moment("END_OF_TIME"))
    return df.unionByName(rows.select(*df.columns))


def _portion(df: DataFrame, a, b, where: Column | None, middle: dict[str, Column] | None, now) -> DataFrame:
    """Rows that meet [a, b) are parted into what lies before, inside and after; inside takes new values or goes.

    With a system axis, only current rows are changed: the old row ends now, its parts begin now.
    """
    start, end = AXES["valid"]
    a, b = moment(a), moment(b)
    hit = (F.col(start) < b) & (F.col(end) > a) & (F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
    system = "system" in axes(df)
    if system:
        hit = hit & (F.col(AXES["system"][1]) == moment("END_OF_TIME"))
    kinds = {f.name: f.dataType for f in df.schema}

    def part(low: Column, high: Column, values: dict[str, Column]) -> Column:
        held = {start: low, end: high} | values
        if system:
            held |= {AXES["system"][0]: moment(now), AXES["system"][1]: moment("END_OF_TIME")}
        return F.struct(*[held.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in df.columns])

    parts = [part(F.col(start), a, {}), part(b, F.col(end), {})]
    if middle is not None:
        parts.append(part(F.greatest(F.col(start), a), F.least(F.col(end), b), middle))
    kept = F.filter(F.array(*parts), lambda x: x[start] < x[end])
    same = F.struct(*[F.col(c).alias(c) for c in df.columns])
    if system:
        closed = F.struct(*[(moment(now).cast(kinds[c]) if c == AXES["system"][1] else F.col(c)).alias(c) for c in df.columns])
        kept = F.concat(F.array(closed), kept)
    return df.select(F.explode(F.when(hit, kept).otherwise(F.array(same))).alias("x")).select("x.*")


def update_portion(df: DataFrame, a, b, values: dict[str, Column], where: Column | None = None, now="NOW") -> DataFrame:
    """UPDATE ... FOR PORTION OF VALID_TIME FROM a TO b."""
    return _portion(df, a, b, where, values, now)


def delete_portion(df: DataFrame, a, b, where: Column | None = None, now="NOW") -> DataFrame:
    """DELETE ... FOR PORTION OF VALID_TIME FROM a TO b."""
    return _portion(df, a, b, where, None, now)


def insert_portion(df: DataFrame, rows: DataFrame, a, b, now="NOW") -> DataFrame:
    taken = {c for pair in AXES.values() for c in pair} & set(rows.columns)
    if taken:
        raise ValueError(f"periods come from FOR PORTION OF, not from columns: {', '.join(sorted(taken))}")
    return append(df, rows.withColumn(AXES["valid"][0], moment(a)).withColumn(AXES["valid"][1], moment(b)), now)


def retract(df: DataFrame, where: Column, a="NOW", b="END_OF_TIME", now="NOW") -> DataFrame:
    """Rows that meet the condition no longer hold in [a, b): they are truncated, shifted, split or dropped."""
    return delete_portion(df, a, b, where, now)


def upsert(df: DataFrame, rows: DataFrame, keys: list[str], now, auto_split: bool = False) -> DataFrame:
    """Close current versions of the keys where the new ones begin and add the new ones.

    Rows without a period hold from now on. A version that begins inside a new period overlaps it: an
    error, unless auto_split cuts or drops it.
    """
    start, end = AXES["valid"]
    if start not in rows.columns:
        rows = rows.withColumn(start, moment(now))
    if end not in rows.columns:
        rows = rows.withColumn(end, moment("END_OF_TIME"))
    marks = rows.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col(start).alias("_from"), F.col(end).alias("_to"))
    met = df.join(marks, reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_key_{k}") for k in keys]), "left")
    overlap = (F.col(start) < F.col("_to")) & (F.col(end) > F.col("_from"))
    if not auto_split and met.filter(overlap & (F.col(start) >= F.col("_from")) & F.col("_from").isNotNull()).head(1):
        raise ValueError("a stored period overlaps a new one; use auto_split")
    if rows.groupBy(*keys).count().filter("count > 1").head(1):
        raise ValueError("several new rows for one key")
    hit = F.coalesce(overlap, F.lit(False))
    system = "system" in axes(df)
    if system:
        hit = hit & (F.col(AXES["system"][1]) == moment("END_OF_TIME"))

    def part(low: Column, high: Column) -> Column:
        held = {start: low, end: high}
        if system:
            held |= {AXES["system"][0]: moment(now), AXES["system"][1]: moment("END_OF_TIME")}
        return F.struct(*[held.get(c, F.col(c)).alias(c) for c in df.columns])

    kept = F.filter(F.array(part(F.col(start), F.col("_from")), *([part(F.col("_to"), F.col(end))] if auto_split else [])), lambda x: x[start] < x[end])
    if system:
        closed = F.struct(*[(moment(now) if c == AXES["system"][1] else F.col(c)).alias(c) for c in df.columns])
        kept = F.concat(F.array(closed), kept)
    same = F.struct(*[F.col(c).alias(c) for c in df.columns])
    out = met.select(F.explode(F.when(hit, kept).otherwise(F.array(same))).alias("x")).select("x.*")
    return append(out, rows, now)


def erase(df: DataFrame, where: Column) -> DataFrame:
    """Remove rows for good, in all versions."""
    return df.filter(~F.coalesce(where, F.lit(False)))
