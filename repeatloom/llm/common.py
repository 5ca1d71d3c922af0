"""Shared folder, intermediate tables and table readers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one is made in local mode only: on a
    cluster executors could not read each other's machine-local folders, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not at:
        at = tempfile.mkdtemp(prefix="repeatloom-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir() or at
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/repeatloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends here and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._repeatloom_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables of materialise() that no later result reads."""
    for df in frames:
        spark, path = df.sparkSession, df._repeatloom_path
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Texts may be long: Arrow batches between the JVM and Python hold at most 1000 rows and about 8 MB, unless the session has less."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, str(most))


@lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def release() -> None:
    """Gives freed memory back to the system: Python workers live on after a task, and other stages run beside them."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def tidy(run):
    """run, a function over a task's Arrow batches, with release() at the task's end."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return task


GROUPS = 10_000  # whose counts are broadcast by draw()


def draw(rows: DataFrame, rank: Column, n: int, by: str | None = None) -> DataFrame:
    """At most n rows, or n of each group of by: those of least rank, a uniform 64-bit hash.

    Groups are counted first, and rows whose hash lies far above what n rows need go where they are read, so what is
    shuffled is a few times n rows of each group, at any size of the corpus. The counts are broadcast where there are at most
    GROUPS; a join by shuffle would send all rows of a group, texts and all, to one task. Rows without a group are left out."""
    fine = 1 << 30
    need = lambda count: F.least(F.lit(fine), F.floor(F.lit(fine * (4.0 * n + 100)) / F.greatest(count, F.lit(1))) + 1)
    near = rows.withColumn("_rank", rank)
    if by is None:
        near = near.where(F.pmod("_rank", F.lit(fine)) < need(F.lit(rows.count())))
    else:
        near = near.where(F.col(by).isNotNull())
        counts = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("_count"))
        few = counts.limit(GROUPS + 1).collect()
        if len(few) <= GROUPS:  # else each task still sends at most n rows of a group, by the window's limit
            table = rows.sparkSession.createDataFrame(few, counts.schema)
            near = near.join(F.broadcast(table), by).where(F.pmod("_rank", F.lit(fine)) < need(F.col("_count"))).drop("_count")
    order = Window.partitionBy(*([by] if by else [])).orderBy(F.pmod("_rank", F.lit(fine)), "_rank")
    return near.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n).drop("_rank", "_place")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
