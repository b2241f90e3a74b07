"""Parquet archive: idempotent appends, manifests, range scans, compaction, scrub, garbage plans, retention."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed import hour_partition


def append_blocks(blocks: DataFrame, path: str, height: str = "block_height", digest: str = "block_hash", time: str = "block_time_micros") -> int:
    """Append blocks that are not stored yet, partitioned by date and hour; returns how many.

    The same height with the same digest is skipped, with another digest it is an error before anything is written.
    """
    spark = blocks.sparkSession
    twice = blocks.groupBy(height).agg(F.countDistinct(digest).alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError("conflicting blocks in the batch")
    new = blocks.dropDuplicates([height])
    if _exists(spark, path):
        old = spark.read.parquet(path).select(height, F.col(digest).alias("_stored"))
        if not new.join(old, height).where(~F.col(digest).eqNullSafe(F.col("_stored"))).isEmpty():
            raise ValueError("a stored block has another digest")
        new = new.join(old, height, "left_anti")
    part = hour_partition(time)
    out = new.withColumn("date", F.substring(part, 1, 10)).withColumn("hour", F.substring(part, 12, 2))
    n = out.count()
    if n:
        out.repartition("date", "hour").sortWithinPartitions(height).write.mode("append").partitionBy("date", "hour").option("compression", "zstd").parquet(path)
    return n


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def manifest(spark: SparkSession, path: str, height: str = "block_height") -> DataFrame:
    """One row per object: path, bytes, sha256 of its content, rows, first and last height."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    files = files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path).groupBy(F.col("_metadata.file_path").alias("path"))
    return files.join(rows.agg(F.count(F.lit(1)).alias("rows"), F.min(height).alias("first"), F.max(height).alias("last")), "path")


def plan_range(manifests: DataFrame, first: int, last: int, most_bytes: int | None = None) -> list[str]:
    """Paths whose heights meet the range; refuses plans beyond the byte budget.  Manifests are small by design."""
    hit = manifests.where((F.col("last") >= first) & (F.col("first") <= last)).select("path", "bytes").collect()
    if most_bytes is not None and sum(r["bytes"] for r in hit) > most_bytes:
        raise ValueError("the range needs more bytes than its budget")
    return sorted(r["path"] for r in hit)


def read_range(spark: SparkSession, manifests: DataFrame, first: int, last: int, height: str = "block_height", most_bytes: int | None = None) -> DataFrame:
    """Rows of the range; every height must be there."""
    paths = plan_range(manifests, first, last, most_bytes)
    rows = spark.read.parquet(*paths).where(F.col(height).between(first, last)) if paths else None
    if rows is None or rows.select(height).distinct().count() != last - first + 1:
        raise ValueError("heights are missing from the range")
    return rows


def verify(spark: SparkSession, manifests: DataFrame, path: str) -> DataFrame:
    """Objects that differ from their manifest: missing, changed or unknown."""
    now = manifest(spark, path).select("path", F.col("sha256").alias("now"), F.col("rows").alias("rows_now"))
    both = manifests.select("path", "sha256", "rows").join(now, "path", "full_outer")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").when((F.col("sha256") != F.col("now")) | (F.col("rows") != F.col("rows_now")), "changed")
    return both.withColumn("state", state).where("state is not null").select("path", "state")


def compact(spark: SparkSession, paths: list[str], into: str, height: str = "block_height", target_bytes: int = 512 << 20) -> str:
    """Rewrite two or more objects as a new generation of sorted objects of about ``target_bytes``, ranges of heights that
    do not overlap; the old ones stay until collected."""
    if len(paths) < 2:
        raise ValueError("compaction takes two objects or more")
    name = hashlib.sha256("|".join(sorted(paths)).encode()).hexdigest()[:16]
    out = f"{into.rstrip('/')}/generation-{name}"
    if not _exists(spark, out):
        hadoop = spark._jsparkSession.sessionState().newHadoopConf()
        objects = [spark._jvm.org.apache.hadoop.fs.Path(x) for x in paths]
        parts = max(1, -(-sum(x.getFileSystem(hadoop).getContentSummary(x).getLength() for x in objects) // target_bytes))
        rows = spark.read.parquet(*paths)
        rows = rows.coalesce(1) if parts == 1 else rows.repartitionByRange(parts, height)
        rows.sortWithinPartitions(height).write.option("compression", "zstd").parquet(out)
    return out


def garbage(present: DataFrame, reachable: DataFrame) -> DataFrame:
    """Files that no manifest reaches."""
    return present.select("path").join(reachable.select("path"), "path", "left_anti")


def retention_digest(plan: DataFrame) -> str:
    """A digest of the set of paths that does not depend on their order and sums up before it meets in one place."""
    h = F.sha2("path", 256)
    parts = [F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("bigint") for i in range(4)]
    sums = plan.select("path").distinct().agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(x).alias(f"x{i}") for i, x in enumerate(parts)], *[F.sum(x.cast("decimal(38,0)")).alias(f"s{i}") for i, x in enumerate(parts)])
    return hashlib.sha256("|".join(str(v) for v in sums.first()).encode()).hexdigest()


def authorised(plan: DataFrame, digest: str) -> DataFrame:
    """The plan, if its digest is the one that was authorised."""
    if retention_digest(plan) != digest:
        raise ValueError("the plan differs from the authorised one")
    return plan


def apply_retention(plan: DataFrame, reachable: DataFrame, digest: str) -> int:
    """Delete the files of an authorised plan; a plan with a file that a manifest reaches deletes nothing.

    Paths stream through the driver; a second run after a failure finishes the first.
    """
    if not authorised(plan, digest).join(reachable.select("path"), "path", "left_semi").isEmpty():
        raise ValueError("the plan holds a reachable object")
    spark, n = plan.sparkSession, 0
    hadoop = spark._jsparkSession.sessionState().newHadoopConf()
    for r in plan.select("path").distinct().toLocalIterator():
        path = spark._jvm.org.apache.hadoop.fs.Path(r["path"])
        n += path.getFileSystem(hadoop).delete(path, False)
    return n


def read_cursors(spark: SparkSession, path: str, source: str, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """Raw observations of a source from cursor ``first`` to ``last``, both (epoch, offset) and inclusive, in order.

    The bounds reach the scan; an offset missing inside an epoch raises.
    """
    c = F.struct("cursor_epoch", "cursor_offset")
    at = lambda x: F.struct(F.lit(x[0]).cast("bigint").alias("cursor_epoch"), F.lit(x[1]).cast("bigint").alias("cursor_offset"))
    rows = spark.read.parquet(path).where((F.col("source_id") == source) & F.col("cursor_epoch").between(first[0], last[0]))
    rows = rows.where((c >= at(first)) & (c <= at(last)))
    holes = rows.groupBy("cursor_epoch").agg((F.max("cursor_offset") - F.min("cursor_offset") + 1 - F.countDistinct("cursor_offset")).alias("holes"))
    if not holes.where("holes > 0").isEmpty():
        raise ValueError("cursors are missing from the range")
    return rows.orderBy("cursor_epoch", "cursor_offset")


def receipt_hint(hints: DataFrame, digest: str) -> tuple[int, int]:
    """First and last record sequence that hints(first_digest, last_digest, digest, first, last) name for a digest.

    Only the page whose digest range holds it is read; a digest without one means that the index must be rebuilt.
    """
    hit = hints.where((F.col("first_digest") <= digest) & (F.col("last_digest") >= digest) & (F.col("digest") == digest)).select("first", "last").limit(2).collect()
    if len(hit) != 1:
        raise LookupError("the receipt index must be rebuilt")
    return hit[0]["first"], hit[0]["last"]


def append_raw(batch: DataFrame, path: str) -> int:
    """Append raw observations: one source, gapless cursors that go on where the store ends."""
    spark = batch.sparkSession
    ends = batch.agg(F.countDistinct("source_id").alias("s"), F.min("cursor_offset").alias("lo"), F.max("cursor_offset").alias("hi"), F.count(F.lit(1)).alias("n"), F.countDistinct("cursor_offset").alias("u")).first()
    if not ends["n"]:
        return 0
    if ends["s"] != 1 or ends["u"] != ends["n"] or ends["hi"] - ends["lo"] + 1 != ends["n"]:
        raise ValueError("mixed sources, repeated cursors or a cursor gap")
    if _exists(spark, path):
        last = spark.read.parquet(path).agg(F.max("cursor_offset")).first()[0]
        if last is not None and ends["lo"] != last + 1:
            raise ValueError("the batch does not follow the stored cursor")
    batch.write.mode("append").parquet(path)
    return ends["n"]


def page_outcome(page: DataFrame, seen: DataFrame) -> DataFrame:
    """New records of a time page: sorted by (time, id), repeats and records seen at the boundary dropped."""
    return page.dropDuplicates(["time", "id"]).join(seen.select("time", "id"), ["time", "id"], "left_anti").orderBy("time", "id")


def inspect(events: DataFrame) -> DataFrame:
    return events.groupBy("chain_id").agg(F.countDistinct("block_height").alias("blocks"), F.count(F.lit(1)).alias("events"))


def cursor_gaps(raw: DataFrame) -> DataFrame:
    before = F.lag("cursor_offset").over(Window.partitionBy("source_id").orderBy("cursor_offset"))
    return raw.withColumn("_b", before).where(F.col("cursor_offset") - F.col("_b") > 1).select("source_id", (F.col("_b") + 1).alias("gap_from"), (F.col("cursor_offset") - 1).alias("gap_to"))


def new_path(root: str) -> str:
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"
