"""Structured Streaming: sequencing, provisional matching, throughput, deduplication, dead letters.

State is kept per key with ``applyInPandasWithState``; late rows are routed by state, never dropped by a watermark alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SEQUENCED = "chain string, height bigint, digest string, decision string, gap_from bigint, gap_to bigint"


class Sequencer:
    """Contiguous emission of blocks by height; the pure rules, so they can be tested without a stream."""

    def __init__(self, state: dict | None = None, most_pending: int = 4096, retained: int = 1024) -> None:
        self.s = state or {"mark": None, "pending": {}, "kept": {}, "gap": None, "red": False}
        self.most, self.retained = most_pending, retained

    def observe(self, height: int, digest: str) -> list[tuple]:
        s, key = self.s, str(height)
        if s["red"]:
            return [(height, digest, "AwaitOperator", None, None)]
        if s["mark"] is not None and height <= s["mark"]:
            old = s["kept"].get(key)
            if old is None:
                return [(height, digest, "VerifyHistorical", None, None)]
            if old == digest:
                return [(height, digest, "Duplicate", None, None)]
            s["red"] = True
            return [(height, digest, "Divergence", None, None)]
        if key in s["pending"]:
            if s["pending"][key] == digest:
                return [(height, digest, "Merged", None, None)]
            s["red"] = True
            return [(height, digest, "Divergence", None, None)]
        nxt = s["mark"] + 1 if s["mark"] is not None else height
        if len(s["pending"]) >= self.most and height != nxt:
            return [(height, digest, "Refused", None, None)]
        s["pending"][key] = digest
        out = []
        if s["mark"] is None:
            s["mark"] = height - 1
        while (k := str(s["mark"] + 1)) in s["pending"]:
            s["mark"] += 1
            s["kept"][k] = s["pending"].pop(k)
            s["kept"].pop(str(s["mark"] - self.retained), None)
            out.append((s["mark"], s["kept"][k], "Emit", None, None))
        if s["pending"]:
            gap = [s["mark"] + 1, min(map(int, s["pending"])) - 1]
            if gap != s["gap"]:
                out.append((height, digest, "RequestGap", *gap))
            s["gap"] = gap
        else:
            s["gap"] = None
        return out or [(height, digest, "AwaitMoreEvidence", None, None)]


def sequence(blocks: DataFrame) -> DataFrame:
    """Decisions for a stream of (chain, height, digest, ordinal): one key per chain."""

    def run(key, pdfs: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq = Sequencer(json.loads(state.get[0]) if state.exists else None)
        out = []
        rows = pd.concat(list(pdfs)).sort_values("ordinal", kind="stable")
        for height, digest in zip(rows["height"].tolist(), rows["digest"].tolist()):
            out += [(key[0], *x) for x in seq.observe(int(height), digest)]
        state.update((json.dumps(seq.s),))
        frame = pd.DataFrame(out, columns=["chain", "height", "digest", "decision", "gap_from", "gap_to"])
        yield frame.astype({"gap_from": "Int64", "gap_to": "Int64"})

    return blocks.groupBy("chain").applyInPandasWithState(run, SEQUENCED, "state string", "append", GroupStateTimeout.NoTimeout)


LANE = "key string, digest string, decision string"


class ProvisionalLane:
    """Provisional rows of one key against committed ones: confirm, conflict, refuse, expire."""

    def __init__(self, rows: list | None = None, ttl: int = 60_000, most: int = 8) -> None:
        self.rows, self.ttl, self.most = rows or [], ttl, most

    def expire(self, now: int) -> list[tuple[str, str]]:
        old = [r for r in self.rows if now - r[1] > self.ttl]
        self.rows = [r for r in self.rows if now - r[1] <= self.ttl]
        return [(r[0], "Expired") for r in old]

    def provisional(self, digest: str, now: int) -> list[tuple[str, str]]:
        out = self.expire(now)
        if any(r[0] == digest for r in self.rows):
            return [*out, (digest, "StillOpen")]
        if len(self.rows) >= self.most:
            return [*out, (digest, "Refused")]
        self.rows.append([digest, now])
        return [*out, (digest, "Open")]

    def committed(self, digest: str, now: int) -> list[tuple[str, str]]:
        out = self.expire(now)
        if not self.rows:
            return [*out, (digest, "Ignored")]
        if any(r[0] == digest for r in self.rows):
            self.rows = [r for r in self.rows if r[0] != digest]
            return [*out, (digest, "Confirmed")]
        self.rows = []
        return [*out, (digest, "Conflict")]


def match_provisional(rows: DataFrame, ttl: int = 60_000) -> DataFrame:
    """Decisions for a stream of (key, digest, committed, now, ordinal)."""

    def run(key, pdfs: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lane = ProvisionalLane(json.loads(state.get[0]) if state.exists else None, ttl)
        out = []
        frame = pd.concat(list(pdfs)).sort_values(["now", "ordinal"], kind="stable")
        for digest, done, now in zip(frame["digest"].tolist(), frame["committed"].tolist(), frame["now"].tolist()):
            out += [(key[0], d, x) for d, x in (lane.committed if done else lane.provisional)(digest, int(now))]
        state.update((json.dumps(lane.rows),))
        yield pd.DataFrame(out, columns=["key", "digest", "decision"])

    return rows.groupBy("key").applyInPandasWithState(run, LANE, "state string", "append", GroupStateTimeout.NoTimeout)


def provisional_watermark(blocks: DataFrame, chain: str, order: list[str], height: str) -> DataFrame:
    """``blocks`` plus ``watermark`` (before the row) and ``decision``: a height above every one before it is published,
    whatever gap it leaves; any other is held against what is kept.  A batch's rows; the running maximum is the state."""
    before = F.max(height).over(Window.partitionBy(chain).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col(height) > F.col("watermark"), F.lit(True))
    return blocks.withColumn("watermark", before).withColumn("decision", F.when(fresh, "PublishProvisional").otherwise("Retained"))


def failed_over(primary: DataFrame, independent: DataFrame, chain: str, height: str) -> DataFrame:
    """The rows of both sources with one way over: below a chain's failover height the primary's, from it on the
    independent's.  That height is the first one that the independent source has and the primary lacks."""
    lacking = independent.join(primary.select(chain, height), [chain, height], "left_anti")
    at = lacking.groupBy(chain).agg(F.min(height).alias("failover_height"))
    rows = primary.withColumn("source", F.lit("primary")).unionByName(independent.withColumn("source", F.lit("independent")))
    before = F.coalesce(F.col(height) < F.col("failover_height"), F.lit(True))
    return rows.join(at, chain, "left").where(before == (F.col("source") == "primary"))


def throughput(events: DataFrame, time: str = "ts", width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Windowed counts with a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("n")).select("window.start", "n")


def deduplicated(messages: DataFrame, time: str = "ts", key: str = "message_id", late: str = "1 minute") -> DataFrame:
    return messages.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def routed(batch: DataFrame, good: str, sinks: dict[str, str]) -> None:
    """One batch to its sinks by lane: the good ones and the dead letters, each row exactly once."""
    batch = batch.persist()
    try:
        batch.where(F.expr(good)).write.mode("append").parquet(sinks["good"])
        batch.where(~F.coalesce(F.expr(good), F.lit(False))).write.mode("append").parquet(sinks["dead"])
    finally:
        batch.unpersist()
