"""Archive, spool, parsers and streaming lanes."""

import json

import pytest
from pyspark.sql import functions as F

from quarrystone.sources import archive, parsers, schemas, spool
from quarrystone.streaming import lanes


def blocks(spark, heights, tag="h"):
    return spark.createDataFrame([(h, f"{tag}{h}", 1_700_000_000_000_000 + h * 1_800_000_000) for h in heights], "block_height bigint, block_hash string, block_time_micros bigint")


def test_archive_round_trip(spark, tmp_path):
    path = str(tmp_path / "blocks")
    assert archive.append_blocks(blocks(spark, range(10)), path) == 10
    assert archive.append_blocks(blocks(spark, range(5, 15)), path) == 5
    with pytest.raises(ValueError, match="another digest"):
        archive.append_blocks(blocks(spark, [3, 20], "x"), path)
    man = archive.manifest(spark, path).persist()
    assert archive.read_range(spark, man, 2, 12).count() == 11
    with pytest.raises(ValueError, match="missing"):
        archive.read_range(spark, man, 10, 16)
    with pytest.raises(ValueError, match="budget"):
        archive.plan_range(man, 0, 20, most_bytes=10)
    assert archive.verify(spark, man, path).isEmpty()
    paths = archive.plan_range(man, 0, 14)
    new = archive.compact(spark, paths, str(tmp_path / "compact"))
    assert spark.read.parquet(new).count() == 15 and archive.compact(spark, paths, str(tmp_path / "compact")) == new
    left = archive.garbage(man.select("path"), man.where("first < 5").select("path"))
    assert archive.authorised(left, archive.retention_digest(left)).count() == left.count()
    with pytest.raises(ValueError):
        archive.authorised(left, "0")


def test_raw_cursors(spark, tmp_path):
    path = str(tmp_path / "raw")
    rows = lambda r, s="s": spark.createDataFrame([(s, i, b"x") for i in r], "source_id string, cursor_offset bigint, payload binary")
    assert archive.append_raw(rows(range(3)), path) == 3 and archive.append_raw(rows(range(3, 6)), path) == 3
    for bad in (rows([7]), rows([6, 8]), rows([6]).union(rows([7], "t"))):
        with pytest.raises(ValueError):
            archive.append_raw(bad, path)
    assert archive.cursor_gaps(rows([1, 2, 5])).collect()[0][1:] == (3, 4)


def test_schema_is_checked(spark, tmp_path):
    spark.createDataFrame([], schemas.schema("market_positioning")).write.parquet(str(tmp_path / "ok"))
    assert schemas.read(spark, "market_positioning", str(tmp_path / "ok")).count() == 0
    spark.range(3).write.parquet(str(tmp_path / "no"))
    with pytest.raises(ValueError, match="market_positioning"):
        schemas.read(spark, "market_positioning", str(tmp_path / "no"))


def test_spool(spark, tmp_path):
    data = spool.segment([b"one", b"", b"three"])
    (tmp_path / "a.seg").write_bytes(data)
    (tmp_path / "b.seg").write_bytes(data[:-5])
    recs = spool.read(spark, str(tmp_path))
    good = spool.recovered(recs).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(r.n for r in good.collect()) == [2, 3]
    assert sorted(r.cut_bytes for r in spool.report(recs).collect()) == [0, 36]


def test_parsers(spark):
    side = {"user": "u", "start_pos": "-1.5", "oid": 7}
    line = json.dumps({"block_number": 5, "events": [{"coin": "BTC", "side": "A", "px": "10.25", "sz": "2", "hash": "0x", "side_info": [side, side | {"oid": 8}]}]})
    lines = spark.createDataFrame([(line,)], "value string")
    legs = parsers.trade_legs(parsers.records(lines, "trades")).collect()
    assert [(int(r.px), int(r.start_pos), r.oid) for r in legs] == [(1025000000, -150000000, 7), (1025000000, -150000000, 8)]
    assert parsers.classify(lines).first().kind == "trades"
    with pytest.raises(Exception):
        parsers.records(spark.createDataFrame([("{broken",)], "value string"), "trades").collect()
    topic = lambda x: bytes.fromhex("00" * 12 + x * 20)
    log = [(b"a" * 20, bytes.fromhex(parsers.TOPICS["Transfer"]), topic("11"), topic("22"), None, b"\0" * 31 + b"\5"), (b"a" * 20, bytes.fromhex(parsers.TOPICS["Transfer"]), topic("11"), topic("22"), b"\0" * 31 + b"\7", b"")]
    got = parsers.decode_logs(spark.createDataFrame(log, "address binary, topic0 binary, topic1 binary, topic2 binary, topic3 binary, data binary")).collect()
    assert [(r.standard, r.sender, int(r.amount_hex or r.token_hex, 16)) for r in got] == [("erc20", "11" * 20, 5), ("erc721", "11" * 20, 7)]
    act = spark.createDataFrame([(b"\1\0\0\5xyz",), (b"\1",)], "d binary").select(parsers.action_bytes(F.col("d")).alias("a")).collect()
    assert (act[0].a.action, bytes(act[0].a.payload), act[1].a) == (5, b"xyz", None)
    fam = parsers.families(spark.createDataFrame([("l2Book",), ("new",)], "channel string")).collect()
    assert {r.channel: r.lane for r in fam} == {"l2Book": "provisional", "new": "quarantine"}


def test_sequencer_rules():
    s = lanes.Sequencer()
    seen = [x[2] for h, g in [(1, "a"), (3, "c"), (3, "c"), (4, "d"), (2, "b"), (2, "b"), (0, "z"), (2, "x"), (9, "q")] for x in s.observe(h, g)]
    assert seen == ["Emit", "RequestGap", "Merged", "AwaitMoreEvidence", "Emit", "Emit", "Emit", "Duplicate", "VerifyHistorical", "Divergence", "AwaitOperator"]
    lane = lanes.ProvisionalLane(ttl=10)
    got = [d for f, g, t in [(0, "a", 0), (0, "a", 1), (1, "a", 2), (1, "a", 3), (0, "b", 4), (1, "c", 5), (0, "d", 6), (0, "e", 30)] for _, d in (lane.committed if f else lane.provisional)(g, t)]
    assert got == ["Open", "StillOpen", "Confirmed", "Ignored", "Open", "Conflict", "Open", "Expired", "Open"]


def run_stream(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    rows = [("c", h, f"d{h}", i) for i, h in enumerate([1, 2, 4, 5, 3, 3])]
    spark.createDataFrame(rows, "chain string, height bigint, digest string, ordinal bigint").coalesce(1).write.json(str(tmp_path / "in"))
    src = spark.readStream.schema("chain string, height bigint, digest string, ordinal bigint").json(str(tmp_path / "in"))
    got = run_stream(spark, lanes.sequence(src), tmp_path, "sequenced")
    assert [r.height for r in got if r.decision == "Emit"] == [1, 2, 3, 4, 5]
    rows = [("k", "a", False, 0, 0), ("k", "a", True, 5, 1), ("k", "b", True, 6, 2)]
    spark.createDataFrame(rows, "key string, digest string, committed boolean, now bigint, ordinal bigint").coalesce(1).write.json(str(tmp_path / "lane"))
    src = spark.readStream.schema("key string, digest string, committed boolean, now bigint, ordinal bigint").json(str(tmp_path / "lane"))
    assert [r.decision for r in run_stream(spark, lanes.match_provisional(src), tmp_path, "matched")] == ["Open", "Confirmed", "Ignored"]


def test_routing(spark, tmp_path):
    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "id int, s string")
    sinks = {"good": str(tmp_path / "g"), "dead": str(tmp_path / "d")}
    lanes.routed(df, "s = 'ok'", sinks)
    assert spark.read.parquet(sinks["good"]).count() == 1 and spark.read.parquet(sinks["dead"]).count() == 2


def test_node_records_refuse_other_shapes(spark):
    from quarrystone.sources import node

    one = lambda text: spark.createDataFrame([(text,)], "value string")
    event = '{"block_number": 1, "events": [{"time": "t", "hash": "h", "inner": %s}]}'
    good = ['{"Delegation": {"user": "u", "validator": "v", "amount": "1", "is_undelegate": false}}', '{"LedgerUpdate": {"users": [], "delta": {"VaultDeposit": {}}}}']
    assert [node.misc_events(one(event % g)).first().kind for g in good] == ["MiscEvent", "MiscEvent"]
    bad = ['{"Delegation": {"user": "u"}}', '{"New": {}}', '{"CDeposit": {}, "Funding": {}}', '{"LedgerUpdate": {"users": [], "delta": {"Unheard": {}}}}', "{}"]
    for b in bad:
        with pytest.raises(Exception):
            node.misc_events(one(event % b)).collect()
    with pytest.raises(Exception):
        node.signed_actions(one('{"abci_block": {"round": 1}, "signed_action_bundles": [{"signed_actions": [{"action": {"type": "unheard"}}]}]}')).collect()
    with pytest.raises(Exception):
        node.order_snapshot(spark.createDataFrame([("f", '[["", [[], []]]]')], "file string, value string")).collect()
    rows = [("trades", '{"block_number": 1, "events": []}'), ("misc_events", event % '{"LedgerUpdate": {"users": [], "delta": {"Liquidation": {}}}}'), ("l4_snapshots", "[]"), ("fills", "{}")]
    got = node.record_kinds(spark.createDataFrame(rows, "stream string, value string")).collect()
    assert [r.kind for r in got] == ["EmptyBatch", "Liquidation", "L4Snapshot", "Fill"]
    with pytest.raises(Exception):
        node.record_kinds(spark.createDataFrame([("other", "{}")], "stream string, value string")).collect()


def test_cursor_ranges_hints_and_retention(spark, tmp_path):
    from quarrystone.sources import archive

    raw = spark.createDataFrame([("s", e, o, f"{e}/{o}") for e in (1, 2) for o in range(10)] + [("t", 1, 5, "x")], "source_id string, cursor_epoch bigint, cursor_offset bigint, payload string")
    raw.write.parquet(str(tmp_path / "raw"))
    got = archive.read_cursors(spark, str(tmp_path / "raw"), "s", (1, 8), (2, 1)).collect()
    assert [r.payload for r in got] == ["1/8", "1/9", "2/0", "2/1"]
    raw.where("cursor_offset <> 4").write.parquet(str(tmp_path / "holes"))
    with pytest.raises(ValueError):
        archive.read_cursors(spark, str(tmp_path / "holes"), "s", (1, 0), (1, 9))
    hints = spark.createDataFrame([("a", "m", "c", 1, 5), ("n", "z", "q", 6, 9)], "first_digest string, last_digest string, digest string, first long, last long")
    assert archive.receipt_hint(hints, "q") == (6, 9)
    with pytest.raises(LookupError):
        archive.receipt_hint(hints, "d")
    files = sorted(str(p) for p in (tmp_path / "raw").glob("*.parquet"))
    plan = spark.createDataFrame([(f,) for f in files], "path string")
    digest = archive.retention_digest(plan.orderBy(F.col("path").desc()))
    assert digest == archive.retention_digest(plan) != archive.retention_digest(plan.limit(0))
    none = plan.limit(0)
    with pytest.raises(ValueError):
        archive.apply_retention(plan, plan, digest)
    with pytest.raises(ValueError):
        archive.apply_retention(plan, none, "other")
    assert archive.apply_retention(plan, none, digest) == len(files) and not list((tmp_path / "raw").glob("*.parquet"))
    parts = []
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).withColumnRenamed("id", "block_height").write.parquet(str(tmp_path / f"g{i}"))
        parts.append(str(tmp_path / f"g{i}"))
    out = archive.compact(spark, parts, str(tmp_path / "all"), target_bytes=1000)
    assert spark.read.parquet(out).count() == 30
