"""Aggregates that the user defines, and numbers for keys."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.joins import place, ranges_of


#: Groups that a task of a fold holds at once.
HELD = 50_000


def fold(df: DataFrame, keys: list[str], column: str, unit: Any, combine: Callable, finalize: Callable | None = None, kind: str = "double", where: Column | None = None) -> DataFrame:
    """A monoid over each group: unit, an associative combine(a, b) and a last step.

    Each task folds what it has seen of a group to one value before anything is shuffled (sending on what it
    has whenever it holds HELD groups), so a group of any size meets as a few partial values; these come sorted, so the
    last fold holds one group at a time. combine sees plain Python values; NULLs are skipped.
    """
    df = df.filter(where) if where is not None else df
    rows = df.select(*keys, F.col(column).cast(kind).alias("value"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "value"] + [f"value {kind}"])

    def part(last: bool):
        done = finalize if last and finalize else lambda v: v

        def run(batches):
            import pyarrow as pa

            held: dict[tuple, Any] = {}
            fields = None

            def sent():
                out = [(*k, done(v)) for k, v in held.items()]
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], fields.field(i).type) for i in range(len(fields))], names=fields.names)

            for batch in batches:
                fields = batch.schema
                for *own, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = tuple(own)
                    if len(held) >= HELD and own not in held:  # when folding for the last time, rows are sorted: those held are complete
                        yield sent()
                    held[own] = held.get(own, unit) if value is None else combine(held.get(own, unit), value)
            if fields is not None:
                yield sent()

        return run

    partial = rows.mapInArrow(part(False), schema)
    dealt = partial.repartition(*keys).sortWithinPartitions(*keys) if keys else partial.coalesce(1)
    return dealt.mapInArrow(part(True), schema)


def exact_percentiles(df: DataFrame, keys: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles of a numeric column by group, as columns named by shares.

    Equal values are counted first; the distinct ones are dealt by ranges of values, whose counts before a range
    and in all give every value its ranks. So no task holds a group. NULLs are skipped; a group of NULLs gives NULL.
    """
    value = F.col(f"`{column}`")
    counted = df.groupBy(*[F.col(f"`{k}`").alias(f"_g{i}") for i, k in enumerate(keys)], value.alias("_v")).agg(F.count(value).alias("_n"))
    groups = [f"_g{i}" for i in range(len(keys))]
    bounds, held = ranges_of(counted, "_v")
    dealt = counted.withColumn("_range", F.coalesce(place(bounds, len(held), lambda b: b <= F.col("_v")), F.lit(0)))
    sums = dealt.groupBy(*groups, "_range").agg(F.sum("_n").alias("_s"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"_ahead": F.coalesce(F.sum("_s").over(before), F.lit(0)), "_all": F.sum("_s").over(Window.partitionBy(*groups))})
    sums = sums.select(*[F.col(g).alias(f"{g}_") for g in groups], F.col("_range").alias("_range_"), "_ahead", "_all")
    same = F.col("_range") == F.col("_range_")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_"))
    ranked = dealt.join(sums, same)
    inside = Window.partitionBy(*groups, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("_to", F.col("_ahead") + F.sum("_n").over(inside)).withColumn("_from", F.col("_to") - F.col("_n"))
    out = {}
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("_all") - 1)
        here = lambda rank: F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_v").cast("double")))
        low, high = here(F.floor(at)), here(F.ceil(at))
        out[name] = low + (high - low) * F.max(at - F.floor(at))
    return ranked.groupBy(*groups).agg(*[c.alias(n) for n, c in out.items()]).select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], *shares)


def dense_codes(df: DataFrame, column: str, into: str = "code") -> DataFrame:
    """Number the distinct values of a column from 0, in order. Only the distinct values meet in one task."""
    values = df.select(column).distinct().withColumn(into, F.row_number().over(Window.orderBy(F.col(column).asc_nulls_last())) - 1)
    values = values.withColumnRenamed(column, "_value")
    return df.join(values, F.col(column).eqNullSafe(F.col("_value"))).drop("_value")
