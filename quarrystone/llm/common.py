"""Shared helpers: the shared checkpoint folder, tables written there, distributed ranks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master without that setting (tests) gets a folder of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarrystone-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` made, once nothing that is still to run reads them."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(conf).delete(path, True)


def release_memory() -> None:
    """Give a worker's freed memory back at a task's end: workers outlive their tasks and share an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def bucket_count(rows: int, per_bucket: int = 128, most: int = 65536) -> int:
    return max(1, min(most, -(-rows // per_bucket)))


def ranked(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """0-based rank of each row among the rows of equal ``keys``, ordered by ``bucket`` and then ``order``.

    A plain ``row_number() over (partition by keys)`` would put a hot key into one task.  Here each key is cut
    into buckets that respect the order; only bucket counts meet in one place (keys x buckets small rows).
    """
    df = df.withColumn("_b", bucket)
    local = Window.partitionBy(*keys, "_b").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        df.withColumn("_rn", F.row_number().over(local))
        .join(starts, [*keys, "_b"])
        .withColumn(out, F.col("_start") + F.col("_rn") - 1)
        .drop("_b", "_rn", "_start")
    )
