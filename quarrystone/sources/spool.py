"""Length-framed spool files: a Python data source, its writer and crash recovery.

A record is a 4-byte big-endian length, the payload, and the payload's SHA-256.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "path string, ordinal bigint, payload binary, good boolean"


def framed(payload: bytes) -> bytes:
    return struct.pack(">I", len(payload)) + payload + hashlib.sha256(payload).digest()


def segment(payloads: Iterable[bytes]) -> bytes:
    return b"".join(map(framed, payloads))


def unframed(data: bytes) -> Iterator[tuple[bytes, bool]]:
    """Payloads up to the first bad record, which comes last with ``False``."""
    at = 0
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0] if at + 4 <= len(data) else -1
        body, digest = data[at + 4 : at + 4 + max(n, 0)], data[at + 4 + max(n, 0) : at + 36 + max(n, 0)]
        if n < 0 or len(body) < n or hashlib.sha256(body).digest() != digest:
            yield data[at:], False
            return
        yield body, True
        at += 36 + n


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the segments under ``path``; Spark reads the files, so any store it knows will do."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(p, i, body, good) for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, (body, good) in enumerate(unframed(data))]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.bool_())], ["path", "ordinal", "payload", "good"]
            )

    return files.mapInArrow(run, RECORD)


def recovered(records: DataFrame) -> DataFrame:
    """The good prefix of each segment: what recovery keeps."""
    return records.where("good").select("path", "ordinal", "payload")


def report(records: DataFrame) -> DataFrame:
    bad = F.sum(F.when(~F.col("good"), F.octet_length("payload")).otherwise(0))
    return records.groupBy("path").agg(F.count(F.when(F.col("good"), 1)).alias("records"), bad.alias("cut_bytes"))
