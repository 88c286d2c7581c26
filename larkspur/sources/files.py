"""Readers, series and host data."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def guarded(path: str) -> str:
    """A path without parent-folder parts."""
    if ".." in re.split(r"[/\\]", path):
        raise ValueError(f"parent folders are not allowed: {path}")
    return path


def read_csv(spark: SparkSession, path: str, separator: str = ",", header: bool = True, types: dict[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """A CSV file. Types not given are inferred from all values: long if all are whole numbers, else double, else string.

    An unquoted empty cell is NULL, a quoted one the empty text; in numeric columns both are NULL. No value is
    lost: one that doesn't fit a given type is an error.
    """
    raw = spark.read.csv(guarded(path), sep=separator, header=header, inferSchema=False, nullValue="", emptyValue='""')
    if not header:
        raw = raw.toDF(*[f"col{i}" for i in range(len(raw.columns))])
    types = dict(types or {})
    cell = lambda c: F.col(f"`{c}`")
    filled = lambda c: cell(c).isNotNull() & (cell(c) != '""')
    if unknown := [c for c in raw.columns if c not in types]:
        fits = lambda c, kind: F.coalesce(F.min(F.when(filled(c), cell(c).try_cast(kind).isNotNull())), F.lit(False))
        found = raw.agg(*[fits(c, k).alias(f"{k}{i}") for i, c in enumerate(unknown) for k in ("bigint", "double")]).first()
        for i, c in enumerate(unknown):
            types[c] = "bigint" if found[f"bigint{i}"] else "double" if found[f"double{i}"] else "string"
    text = lambda c: F.when(cell(c) == '""', "").otherwise(cell(c))
    known = lambda c, kind: F.when(filled(c) & cell(c).try_cast(kind).isNull(), F.raise_error(F.concat(F.lit(f"column {c} has a value that is no {kind}: "), cell(c))).cast(kind)).otherwise(cell(c).try_cast(kind))
    out = raw.select(*[(text(c) if types[c] == "string" else cell(c).try_cast(types[c]) if c in unknown else known(c, types[c])).alias(c) for c in raw.columns])
    return out.limit(limit) if limit is not None else out


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Flat Parquet columns."""
    df = spark.read.parquet(guarded(path))
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    if nested:
        raise ValueError(f"nested columns: {', '.join(nested)}")
    return df


def from_maps(spark: SparkSession, rows: list[dict], schema: str | None = None) -> DataFrame:
    """Rows as dicts; a column's type is that of its first value that is not None."""
    if schema:
        return spark.createDataFrame(rows, schema)
    names = list(dict.fromkeys(k for r in rows for k in r))
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string", dt.date: "date", dt.datetime: "timestamp_ntz"}
    first = {n: next((r[n] for r in rows if r.get(n) is not None), None) for n in names}
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"`{n}` {kinds.get(type(first[n]), 'string')}" for n in names))


def from_tuples(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    return from_maps(spark, [dict(zip(names, r, strict=True)) for r in rows])


def to_tuples(df: DataFrame) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def generate_series(spark: SparkSession, start, end, step=1, unit: str | None = None) -> DataFrame:
    """An inclusive series in a column `value`: numbers by step, or timestamps by step units."""
    if isinstance(start, dt.datetime):
        from larkspur.functions.dates import UNITS, _unit

        if _unit(unit) not in UNITS:
            span = (end.year - start.year) * 12 + end.month - start.month
            width = step * {"month": 1, "quarter": 3, "year": 12}[_unit(unit)]
            base = F.lit(start).cast("timestamp_ntz")
            out = spark.range(span // width + 1).select((base + F.make_ym_interval(F.lit(0), (F.col("id") * width).cast("int"))).alias("value"))
            return out.filter(F.col("value") <= F.lit(end).cast("timestamp_ntz"))
        size = dt.timedelta(microseconds=step * UNITS[_unit(unit)])
        n = (end - start) // size + 1
        zero = int((start - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
        return spark.range(max(0, n)).select(F.timestamp_micros(F.lit(zero) + F.col("id") * int(size / dt.timedelta(microseconds=1))).cast("timestamp_ntz").alias("value"))
    n = int((end - start) / step + 1e-9) + 1
    return spark.range(max(0, n)).select((F.lit(start) + F.col("id") * step).alias("value"))


def missing(df: DataFrame) -> DataFrame:
    """Per column, how many values are NULL."""
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])


def select_rows(df: DataFrame, numbers: list[int], order: list) -> DataFrame:
    """Rows by their place, from 0, in an order. The places are found by one sorted pass over few rows, not by collecting."""
    top = max(numbers, default=-1) + 1
    from pyspark.sql import Window

    first = df.orderBy(*order).limit(top)
    return first.withColumn("_n", F.row_number().over(Window.orderBy(*order)) - 1).filter(F.col("_n").isin(*numbers)).drop("_n")
