"""Windows over streams: the batch forms of the engine, on data without end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, time: str, width: str, aggs: dict[str, Column], keys: list[str] = (), slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling (or, with slide, sliding) windows; state older than `late` is dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = stream.withWatermark(time, late).groupBy(w, *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *aggs)


def sessions(stream: DataFrame, time: str, gap: str, aggs: dict[str, Column], keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Windows that end after a gap without rows of the key."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, *aggs)


def rotating(forest, every: Callable):
    """A foreachBatch function that replaces the oldest trees by ones grown on each batch; every(forest) sees each new forest."""
    from larkspur.operators.iforest import rotate

    held = {"forest": forest}

    def batch(df: DataFrame, number: int) -> None:
        if df.head(1):
            held["forest"] = rotate(held["forest"], df, seed=forest.seed + 1 + number)
            every(held["forest"])

    return batch
