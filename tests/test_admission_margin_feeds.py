import pytest
from pyspark.sql import functions as F

from quarrystone.operators import admission, margin
from quarrystone.sources import feeds


def test_admission(spark):
    df = spark.createDataFrame([(1, 5, "Decimal"), (2, None, "Decimal"), (3, 1, "Boolean"), (4, 7, "Missing")], "id int, v int, kind string")
    a = admission.admit(F.col("v"), F.col("kind"), "Decimal")
    assert [r[0] for r in df.orderBy("id").select(a).collect()] == ["Observed", "Missing", "Malformed", "Missing"]
    assert df.where("id = 1").select(admission.proof(a)).first()[0] is True
    with pytest.raises(Exception, match="missing"):
        df.select(admission.proof(a)).collect()
    with pytest.raises(Exception, match="no depth"):
        spark.range(1).select(admission.depth(F.lit(True))).collect()
    s = spark.createDataFrame([(0, -1, 1, 5, "Green"), (2_000_000, 0, 1, 5, "Green"), (5, 6, 7, 5, "Green"), (5, 0, 9, 0, "Green"), (5, 0, 9, 1, "Red")], "n long, lo long, hi long, m long, h string")
    got = s.select(admission.scored(*[F.col(c) for c in ("n", "lo", "hi", "m", "h")])).collect()
    assert [r[0] for r in got] == [None, "bounds", "outside", "sample", "health"]
    f = spark.sql("SELECT 1 AS e, 2 AS k, CAST(NULL AS INT) AS s, 1 AS r, map('a', 5) AS v, 'Red' AS h UNION ALL SELECT 3, 2, NULL, 1, map('a', 5), 'Green' UNION ALL SELECT 1, 2, 5, 1, map('a', CAST(NULL AS INT)), 'Red'")
    got = f.select(admission.snapshot_errors(*[F.col(c) for c in "ekrvh"[:2]], F.col("s"), F.col("r"), F.col("v"), F.col("h"))).collect()
    assert [r[0] for r in got] == ["red with values", "known before effective", None]
    assert admission.requested_rows("limit=5") == 5 and admission.requested_rows(None) is None
    for bad in ("limit=0", "limit=9999", "x=1", "limit=1&limit=2"):
        with pytest.raises(ValueError):
            admission.requested_rows(bad)
    ids = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert [r.v for r in admission.by_id(ids, ["b", "a", "b"]).collect()] == [2, 1, 2]
    with pytest.raises(Exception, match="unknown id"):
        admission.by_id(ids, ["z"]).collect()
    with pytest.raises(ValueError):
        admission.aligned(1, 1, 2)


def test_margin_models(spark):
    rows = [("a", "m1", 10, 100, 1000, 500, 200), ("a", "m2", -20, 100, 1000, 500, 200), ("b", "m1", 10, 100, 1000, 500, 100), ("c", "m1", 3, 7, 1000, 500, 100), ("d", "m1", 0, 7, 1000, 500, 100)]
    p = spark.createDataFrame(rows, "account string, market string, quantity long, oracle long, initial_bps long, maintenance_bps long, collateral long")
    cross = {r.account: r for r in margin.assess(p, "cross").collect()}
    assert (cross["a"].maintenance, cross["a"].kind, cross["a"].low) == (150, "Range", 100)
    assert (cross["b"].maintenance, cross["b"].kind, cross["b"].low, cross["b"].ratio_e8) == (50, "Exact", 200, 200_000_000)
    assert cross["c"].error == "inexact" and "d" not in cross
    assert {r.account: r.maintenance for r in margin.assess(p, "unified").collect()}["a"] == 100
    iso = {r.account: r for r in margin.assess(p, "isolated", "m2").collect()}
    assert list(iso) == ["a"] and iso["a"].error is None
    assert {r.kind for r in margin.assess(p, "outcome", "m1").collect()} == {"NotApplicable"}


def test_feeds(spark, tmp_path):
    data = [{"time": t, "id": i} for i, t in enumerate([1, 1, 2, 2, 2, 3, 5, 5])]
    fetch = lambda start: [r for r in data if r["time"] >= start][:4]
    assert [r["id"] for r in feeds.crawl(fetch, 0, 4)] == list(range(8))
    for stuck, most in ((lambda start: [{"time": 5, "id": i} for i in range(4)], 9), (lambda start: [{"time": start + i, "id": start + i} for i in range(1, 5)], 3)):
        got = []
        with pytest.raises(feeds.Truncated):  # what was read is given first
            for r in feeds.crawl(stuck, 0, 4, most=most):
                got.append(r)
        assert len(got) in (4, 12)
    path = str(tmp_path / "p")
    msg = lambda *ids: spark.createDataFrame([(i,) for i in ids], "message_id int")
    assert feeds.publish(msg(1, 2, 2), path) == 2 and feeds.publish(msg(2, 3), path) == 1
    cur = str(tmp_path / "c")
    feeds.advance(spark, cur, "s", None, 5)
    feeds.advance(spark, cur, "s", 5, 9)
    assert feeds.current(spark, cur, "s") == (2, 9) and feeds.current(spark, cur, "t") is None
    for expected, to in ((5, 10), (9, 9)):
        with pytest.raises(ValueError):
            feeds.advance(spark, cur, "s", expected, to)
    listing = spark.createDataFrame([("a", "1"), ("b", "1")], "key string, etag string")
    assert [r.key for r in feeds.pending_objects(listing, listing.where("key = 'a'")).collect()] == ["b"]
    seen = {}
    assert [feeds.message_class(m, seen) for m in (b'{"channel": "x"}', b'{"channel": "x"}', b"oops", b'{"channel": "x", "data": {"isSnapshot": true}}')] == ["Snapshot", "Incremental", "Quarantine", "Snapshot"]
    feeds.feature_table(spark.range(10).withColumn("k", F.col("id") % 3), str(tmp_path / "f"), ["k"], ["id"])
    assert spark.read.parquet(str(tmp_path / "f")).count() == 10
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\n\ntwo\n")
    q = feeds.lines_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("lines").count() == 2
