"""The session the engine runs in, and the tables it reads."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; partitions follow the data, not a constant."""
    builder = SparkSession.builder.appName("larkspur")
    if master:
        builder = builder.master(master)
    held = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.cbo.enabled": "true",
        "spark.sql.cbo.joinReorder.enabled": "true",
        # Aggregates that keep objects (percentiles, lists) fall back to sorting beyond so many groups in a task.
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "10000",
    } | {k.replace("__", "."): v for k, v in settings.items()}
    for key, value in held.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Schemas of files by path and time of change, so that a table is opened without reading its footers again.
_SCHEMAS: dict[tuple[str, int], StructType] = {}


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by path; the schema is read once for each state of the file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    key = path, at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime()
    if key in _SCHEMAS:
        return spark.read.schema(_SCHEMAS[key]).parquet(path)
    df = spark.read.parquet(path)
    _SCHEMAS[key] = df.schema
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return parquet(spark, os.path.join(sf_dir, f"{name}.parquet"))


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register tables of a folder as temporary views."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or on a local master without one a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.mkdtemp(prefix='larkspur-')}"


def spread(df: DataFrame) -> DataFrame:
    """df over all cores before costly work per row: dealt anew only where it has fewer partitions than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
