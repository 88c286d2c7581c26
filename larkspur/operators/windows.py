"""Window functions beyond Spark's own: fills, moving aggregates, run numbers, exponential averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def over(keys: list, order: list) -> WindowSpec:
    """Partition and order, NULLs last. With an order, the frame is ROWS up to the current row."""
    w = Window.partitionBy(*keys)
    if not order:
        return w
    return w.orderBy(*[_last(o) for o in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _last(o) -> Column:
    if isinstance(o, Column):
        return o
    name, direction = o if isinstance(o, tuple) else (o, "asc")
    return F.col(name).desc_nulls_last() if direction == "desc" else F.col(name).asc_nulls_last()


def fills(c: Column, w: WindowSpec) -> Column:
    """The last value that is not NULL, up to the current row."""
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


MOVING = {"mavg": F.avg, "msum": F.sum, "mmin": F.min, "mmax": F.max, "mcount": F.count, "mdev": F.stddev_pop}


def moving(kind: str, c: Column, n: int, w: WindowSpec) -> Column:
    """An aggregate over the last n rows, fewer at the start."""
    return MOVING[kind](c).over(w.rowsBetween(1 - n, 0))


def rleid(df: DataFrame, c: str, keys: list[str], order: list, into: str = "rleid") -> DataFrame:
    """Number the runs of equal values from 1 in each partition; NULL equals NULL."""
    w = Window.partitionBy(*keys).orderBy(*[_last(o) for o in order])
    new = F.when(F.row_number().over(w) == 1, 1).when(F.lag(c).over(w).eqNullSafe(F.col(c)), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(into, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def ema(df: DataFrame, c: str, a: float, keys: list[str], order: list[str], into: str = "ema") -> DataFrame:
    """Exponential moving average: e += alpha * (v - e), seeded with the first value.

    a below 1 is alpha, else a period N with alpha 2 / (N + 1). A NULL value leaves the average
    as it was. Rows of a partition stream through in order; only one number is kept between them.
    """
    alpha = a if a < 1 else 2.0 / (a + 1)
    value, group = df.columns.index(c), [df.columns.index(k) for k in keys]
    sort = [F.col(k).asc_nulls_first() for k in keys] + [_last(o) for o in order]
    rows = (df.repartition(*keys) if keys else df.repartition(1)).sortWithinPartitions(*sort)

    def run(batches):
        import pyarrow as pa

        key, e = None, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in group]
            out = []
            for k, v in enumerate(batch.column(value).to_pylist()):
                own = tuple(x[k] for x in columns)
                if own != key:
                    key, e = own, None
                if v is not None:
                    e = float(v) if e is None else e + alpha * (v - e)
                out.append(e)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, into])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return rows.mapInArrow(run, f"{schema}, `{into}` double")
