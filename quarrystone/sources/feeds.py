"""Feeds: file streams, paged crawls, object imports, publishing, progress cursors, feature tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archive import _exists


def block_files(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Stream of whole block files; the checkpoint is the resume cursor."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files).load(path)


def lines_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Stream of newline records; blank lines are left out."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", files).load(path).where(F.trim("value") != "")


def json_blocks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blocks from a folder of JSON files; a malformed file raises."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


class Truncated(RuntimeError):
    """A crawl ended before its source did: what it gave is not everything."""


def crawl(fetch: Callable[[int], list[dict]], start: int, limit: int, overlap: int = 0, most: int = 1024) -> Iterator[dict]:
    """Pages by time: the next page starts at the last record's time less the overlap; repeats are dropped.

    Ends on a short page.  After ``most`` full pages, or where a full page holds nothing new, more may be there that
    it cannot reach: the records so far are given and then ``Truncated`` is raised.
    """
    seen: set[tuple] = set()
    for _ in range(most):
        page = sorted(fetch(start), key=lambda r: (r["time"], str(r["id"])))
        fresh = [r for r in page if (r["time"], r["id"]) not in seen]
        seen = {(r["time"], r["id"]) for r in page if r["time"] >= page[-1]["time"] - overlap} if page else seen
        yield from fresh
        if len(page) < limit:
            return
        if not fresh:
            raise Truncated(f"a full page at {start} holds nothing new")
        start = max(start, page[-1]["time"] - overlap)
    raise Truncated(f"more than {most} pages")


def pending_objects(listing: DataFrame, progress: DataFrame) -> DataFrame:
    """Objects (key, etag) that no finished import covers."""
    return listing.join(progress.select("key", "etag"), ["key", "etag"], "left_anti")


def publish(batch: DataFrame, path: str, key: str = "message_id") -> int:
    """Append messages whose id was never published; returns how many.  Safe to repeat after a failure."""
    spark = batch.sparkSession
    new = batch.dropDuplicates([key])
    if _exists(spark, path):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def advance(spark: SparkSession, path: str, source: str, expected: int | None, to: int) -> None:
    """Compare-and-set of a source's cursor: rows are appended, the largest version holds."""
    now = current(spark, path, source)
    if (now and now[1]) != expected:
        raise ValueError(f"cursor of {source} is {now and now[1]}, not {expected}")
    if expected is not None and to <= expected:
        raise ValueError("cursors only go forward")
    rows = [(source, (now[0] if now else 0) + 1, to)]
    spark.createDataFrame(rows, "source string, version bigint, cursor bigint").write.mode("append").parquet(path)


def current(spark: SparkSession, path: str, source: str) -> tuple[int, int] | None:
    if not _exists(spark, path):
        return None
    best = spark.read.parquet(path).where(F.col("source") == source).agg(F.max(F.struct("version", "cursor"))).first()[0]
    return best and (best["version"], best["cursor"])


def feature_table(rows: DataFrame, path: str, keys: list[str], order: list[str], partitions: int | None = None) -> None:
    """Write a feature table clustered by key and sorted, so min/max statistics prune point-in-time reads."""
    dealt = rows.repartition(partitions, *keys) if partitions else rows.repartition(*keys)
    dealt.sortWithinPartitions(*keys, *order).write.mode("append").option("compression", "zstd").parquet(path)


def snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON snapshot under its schema; unknown or malformed content raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", "true").json(path)


def message_class(payload: bytes, seen: dict[str, str]) -> str:
    """Class of a socket message of a session: first of a channel replaces, later ones add; unreadable ones quarantine."""
    try:
        m = json.loads(payload)
        channel = m["channel"]
    except (ValueError, KeyError, TypeError):
        return "Quarantine"
    first = channel not in seen
    seen[channel] = "open"
    return "Snapshot" if first or (isinstance(m.get("data"), dict) and m["data"].get("isSnapshot")) else "Incremental"
