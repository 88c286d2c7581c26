"""What the operators of this subpackage share: storage that all executors see, names and column helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: what stands between the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Elements of an array that one step of `running` scans together.
AT_ONCE = 256


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The columns asked for of the table `documents`."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see, under spark.checkpoint.dir.

    Only where that setting is absent on a local master (tests, one machine) a temporary folder
    takes its place; on a cluster its absence is an error, as executors share no local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='larkspur-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, drop: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write df as Parquet in a shared folder and read it again: cuts the lineage, survives lost executors.

    drop: tables that an earlier call made and nothing needs any more; their folders are deleted.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    discard(*drop)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables that `materialise` made."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def spare(df: DataFrame, *names: str) -> list[str]:
    """For each name, it or a longer one that no column of df has (in either case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def running(values: Column, combine, zero: Column) -> Column:
    """combine of each element with all before it, for an associative combine.

    Runs of AT_ONCE elements are scanned on their own and then lifted by the runs before them, so an
    array of n elements costs some n * AT_ONCE copies, not n * n.
    """

    def scan(part: Column, out_type: str) -> Column:
        held = F.struct(zero.alias("at"), F.array().cast(out_type).alias("out"))
        step = lambda acc, v: let(combine(acc["at"], v), lambda x: F.struct(x.alias("at"), F.concat(acc["out"], F.array(x)).alias("out")))
        return F.aggregate(part, held, step)["out"]

    def whole(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / AT_ONCE).cast("int"))
        local = F.transform(starts, lambda b: scan(F.slice(v, b * AT_ONCE + 1, F.lit(AT_ONCE)), "array<int>"))
        lift = lambda parts: let(scan(F.transform(parts, lambda p: F.element_at(p, -1)), "array<int>"), lambda ends: F.flatten(F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(F.transform(p, lambda x: combine(F.get(ends, k - 1), x))))))
        return let(local, lift)

    return let(values, lambda v: F.when(F.size(v) <= 0, F.array().cast("array<int>")).otherwise(whole(v)))
