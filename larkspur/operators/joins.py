"""Joins in time: as-of join, window join, newest row per key, gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.dates import micros


def _number(df: DataFrame, name: str) -> Column:
    """An orderable number for a time or numeric column."""
    kind = df.schema[name].dataType.typeName()
    return micros(F.col(f"`{name}`")) if kind in ("date", "timestamp", "timestamp_ntz") else F.col(f"`{name}`")


def asof_join(probe: DataFrame, build: DataFrame, on: tuple[str, str, str], keys: list[tuple[str, str]] = (), how: str = "inner", tie: list[str] = (), hot_keys: bool = False) -> DataFrame:
    """At most one row of build for each row of probe.

    on: (probe time, operator, build time). `>=` takes the latest build row at or before the
    probe row, `>` strictly before, `<=` the earliest at or after, `<` strictly after. keys are pairs
    of equal columns. NULL times and keys never match; `left` keeps such probe rows. tie
    orders build rows of one time (the last wins). Names of build that probe has too get the suffix
    `_right`. One shuffle by key: both sides are tagged, united and carried along a window, so
    no range of rows is ever multiplied. Without keys, or with hot_keys (keys with more rows than a task
    should sort), rows are dealt by time ranges too, and each range is seeded with the last build row before it.
    """
    left_time, op, right_time = on
    if op not in (">=", ">", "<=", "<"):
        raise ValueError(f"as-of operator {op}")
    renamed = {c: f"{c}_right" if c in probe.columns else c for c in build.columns}
    own, other = [f"`{c}`" for c in probe.columns], [f"`{c}`" for c in build.columns]
    key_of = lambda side: [F.col(f"`{k[side]}`").alias(f"_k{i}") for i, k in enumerate(keys)]
    key_names = [f"_k{i}" for i in range(len(keys))]
    null_probe, null_build = F.struct(*own), F.struct(*other)
    left = probe.select(*key_of(0), _number(probe, left_time).alias("_t"), null_probe.alias("_p"))
    right = build.select(*key_of(1), _number(build, right_time).alias("_t"), null_build.alias("_b"), F.struct(*[F.col(f"`{c}`") for c in tie] or [F.lit(0)]).alias("_tie"))
    usable = F.col("_t").isNotNull()
    for k in key_names:
        usable = usable & F.col(k).isNotNull()
    right = right.filter(usable)
    backward = op in (">=", ">")
    # Where equal times match, build rows come first in the direction of the window.
    order_tag = {">=": (0, 1), ">": (1, 0), "<=": (0, 1), "<": (1, 0)}[op]
    both = left.filter(usable).withColumn("_tag", F.lit(order_tag[1])).unionByName(right.withColumn("_tag", F.lit(order_tag[0])), allowMissingColumns=True)
    time = F.col("_t").asc() if backward else F.col("_t").desc()
    if not keys or hot_keys:
        both, key_names = _ranged(both, backward, key_names)
    w = Window.partitionBy(*key_names).orderBy(time, "_tag", F.col("_tie").asc() if backward else F.col("_tie").desc())
    carried = both.withColumn("_b", F.last("_b", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    matched = carried.filter(F.col("_p").isNotNull() & (~F.col("_guard") if "_guard" in carried.columns else F.lit(True)))
    if how == "left":
        matched = matched.select("_p", "_b").unionByName(left.filter(~F.coalesce(usable, F.lit(False))).select("_p"), allowMissingColumns=True)
    else:
        matched = matched.filter(F.col("_b").isNotNull())
    return matched.select(*[F.col(f"_p.{c}") for c in own], *[F.col(f"_b.`{c}`").alias(n) for c, n in renamed.items()])


def place(bounds: Column, count: int, below) -> Column:
    """How many of `count` ascending bounds are below a value, by halving; below(bound) is true for a beginning of them."""

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        more = (acc["low"] < acc["high"]) & below(F.get(bounds, mid))
        return F.struct(F.when(more, mid + 1).otherwise(acc["low"]).alias("low"), F.when(more | (acc["low"] == acc["high"]), acc["high"]).otherwise(mid).alias("high"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(count.bit_length())), F.struct(F.lit(0).alias("low"), F.lit(count).alias("high")), halve)["low"]


#: Rows of a time range, about, and ranges at most (their bounds come to the driver).
RANGE_ROWS, MOST_RANGES = 100_000, 16_384


def ranges_of(df: DataFrame, name: str) -> tuple[Column, list]:
    """Ascending bounds that part the numbers of a column into ranges of about RANGE_ROWS rows: as a column, and as they are."""
    ranges = max(2, min(MOST_RANGES, df.count() // RANGE_ROWS))
    shares = F.split(F.lit(",".join(str(i / ranges) for i in range(1, ranges))), ",").cast("array<double>")
    bounds = sorted(set(df.agg(F.percentile_approx(name, shares, 20 * ranges).alias("q")).first()["q"] or []))
    kind = f"array<{df.schema[name].dataType.simpleString()}>"
    return F.split(F.lit(",".join(map(repr, bounds))), ",").cast(kind) if bounds else F.array().cast(kind), bounds


def _ranged(both: DataFrame, backward: bool, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Deal rows by time ranges, inside keys. Into each range of a key goes a copy of the key's last build row before it."""
    held, bounds = ranges_of(both, "_t")
    edge = (lambda b: b <= F.col("_t")) if backward else (lambda b: b < F.col("_t"))
    dealt = both.withColumn("_range", place(held, len(bounds), edge))
    nearest = F.max_by if backward else F.min_by
    row = F.struct("_t", "_b", "_tie", "_tag")
    last = dealt.groupBy(*keys, "_range").agg(nearest(F.when(F.col("_b").isNotNull(), row), F.when(F.col("_b").isNotNull(), F.struct("_t", "_tie"))).alias("x"))
    # Of each key, a row per range at most: later ranges take the last build row of those before them.
    step = Window.partitionBy(*keys).orderBy("_range" if backward else F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    seeds = last.withColumn("x", F.last("x", ignorenulls=True).over(step)).filter("x is not null")
    seeds = seeds.select(*keys, "_range", "x._t", "x._b", "x._tie", "x._tag").withColumn("_guard", F.lit(True))
    return dealt.withColumn("_guard", F.lit(False)).unionByName(seeds, allowMissingColumns=True), [*keys, "_range"]


AGGREGATES = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max}


def window_join(left: DataFrame, right: DataFrame, times: tuple[str, str], bounds: tuple[int, int], aggs: dict[str, tuple[str, str | None]], keys: list[tuple[str, str]] = ()) -> DataFrame:
    """For each row of left, aggregates over right rows whose time lies in [t + low, t + high].

    Bounds are microseconds for timestamps, plain numbers otherwise. aggs: name -> (function,
    column); an empty window gives SUM 0, COUNT 0 and NULL for the rest. A tagged union and a
    RANGE frame: one shuffle, no pairs. NULL times and keys meet no rows.
    """
    own = F.struct(*[f"`{c}`" for c in left.columns])
    key_names = [f"_k{i}" for i in range(len(keys))]
    of = lambda df, time, side: [*[F.col(f"`{k[side]}`").alias(n) for k, n in zip(keys, key_names, strict=True)], _number(df, time).alias("_t")]
    values = {name: F.col(f"`{c}`") if c else F.lit(1) for name, (_, c) in aggs.items()}
    a = left.select(*of(left, times[0], 0), own.alias("_p"))
    b = right.select(*of(right, times[1], 1), *[v.alias(f"_v_{n}") for n, v in values.items()])
    usable = F.col("_t").isNotNull()
    for k in key_names:
        usable = usable & F.col(k).isNotNull()
    both = a.unionByName(b.filter(usable), allowMissingColumns=True)
    w = Window.partitionBy(*key_names).orderBy("_t").rangeBetween(*bounds)
    out = {}
    for name, (kind, _) in aggs.items():
        value = AGGREGATES[kind](f"_v_{name}").over(w)
        out[name] = F.coalesce(F.when(usable, value), F.lit(0)) if kind in ("sum", "count") else F.when(usable, value)
    return both.withColumns(out).filter(F.col("_p").isNotNull()).select("_p.*", *aggs)


def latest_on(df: DataFrame, time: str, keys: list[str], newest: bool = True) -> DataFrame:
    """The newest (or oldest) row of each key; NULL times lose to any other."""
    order = F.col(time).desc_nulls_last() if newest else F.col(time).asc_nulls_last()
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def gap_fill(spine: DataFrame, data: DataFrame, on: tuple[str, str], keys: list[tuple[str, str]] = ()) -> DataFrame:
    """Every spine row with the last data row at or before it."""
    return asof_join(spine, data, (on[0], ">=", on[1]), list(keys), "left")
