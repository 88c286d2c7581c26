"""Changes to tables: each gives a new DataFrame, the old one stays as it was."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNSIGNED = {"utinyint": 8, "usmallint": 16, "uinteger": 32, "ubigint": 64}


def checked(df: DataFrame, unsigned: dict[str, int] | None = None, enums: dict[str, list[str]] | None = None) -> DataFrame:
    """df, whose rows raise an error where a value is out of its unsigned width or not of its enumeration."""
    for c, width in (unsigned or {}).items():
        ok = F.col(c).isNull() | F.col(c).between(0, F.lit(str(2**width - 1)).cast("decimal(20,0)"))
        df = df.withColumn(c, F.when(ok, F.col(c)).otherwise(F.raise_error(F.lit(f"22003: {c} is out of range for {width} bits"))))
    for c, labels in (enums or {}).items():
        ok = F.col(c).isNull() | F.col(c).isin(*labels)
        df = df.withColumn(c, F.when(ok, F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"22P02: no label of {c}: "), F.col(c)))))
    return df


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns that rows lack are NULL; types are the table's."""
    unknown = set(rows.columns) - set(table.columns)
    if unknown:
        raise ValueError(f"no column {', '.join(sorted(unknown))}")
    kinds = {f.name: f.dataType for f in table.schema}
    given = rows.select(*[(F.col(c).cast(kinds[c]) if c in rows.columns else F.lit(None).cast(kinds[c])).alias(c) for c in table.columns])
    return table.unionByName(given)


def update(table: DataFrame, values: dict[str, Column], where: Column | None = None) -> DataFrame:
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    kinds = {f.name: f.dataType for f in table.schema}
    return table.select(*[(F.when(hit, values[c].cast(kinds[c])).otherwise(F.col(c)) if c in values else F.col(c)).alias(c) for c in table.columns])


def update_from(table: DataFrame, other: DataFrame, on: list[tuple[str, str]], values: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Rows of table that meet a row of other take its values (columns of other are named `o.<column>`).

    Of several rows of other with one key, the first by all columns counts.
    """
    keys = [b for _, b in on]
    first = other.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in other.columns if c not in keys] or [F.lit(1)]))).filter("_n = 1").drop("_n")
    t, o = table.alias("t"), first.withColumn("_hit", F.lit(True)).alias("o")
    met = t.join(o, reduce(lambda a, b: a & b, [F.col(f"t.{a}") == F.col(f"o.{b}") for a, b in on]), "left")
    hit = F.coalesce(F.col("o._hit"), F.lit(False)) & (F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
    kinds = {f.name: f.dataType for f in table.schema}
    return met.select(*[(F.when(hit, values[c].cast(kinds[c])).otherwise(F.col(f"t.{c}")) if c in values else F.col(f"t.{c}")).alias(c) for c in table.columns])


def delete(table: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition is true go; false and unknown stay."""
    return table.filter(~F.coalesce(where, F.lit(False)))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], values: dict[str, Column] | None = None) -> DataFrame:
    """Insert rows with new keys. Rows with known keys change nothing, or set values, where columns of
    the table are `t.<column>` and those of the new row `excluded.<column>`. One full join on the keys."""
    kinds = {f.name: f.dataType for f in table.schema}
    new = rows.select(*[(F.col(c).cast(kinds[c]) if c in rows.columns else F.lit(None).cast(kinds[c])).alias(c) for c in table.columns])
    new = new.dropDuplicates(keys)
    t, e = table.withColumn("_t", F.lit(True)).alias("t"), new.withColumn("_e", F.lit(True)).alias("excluded")
    both = t.join(e, reduce(lambda a, b: a & b, [F.col(f"t.{k}") == F.col(f"excluded.{k}") for k in keys]), "full")
    out = []
    for c in table.columns:
        own, given = F.col(f"t.{c}"), F.col(f"excluded.{c}")
        value = F.when(F.col("t._t").isNull(), given)
        if values and c in values:
            value = value.when(F.col("excluded._e").isNotNull(), values[c].cast(kinds[c]))
        out.append(value.otherwise(own).alias(c))
    return both.select(*out)


def add_column(table: DataFrame, name: str, value: Column) -> DataFrame:
    return table.withColumn(name, value)


def drop_column(table: DataFrame, name: str) -> DataFrame:
    return table.drop(name)


def rename_column(table: DataFrame, old: str, new: str) -> DataFrame:
    return table.withColumnRenamed(old, new)
