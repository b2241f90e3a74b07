"""Operators on small fixtures: point-in-time rules, cohorts, books, cascades, simulation, research, graph."""

import random

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import bitemporal as bt
from quarrystone.operators import book, graph, ledger, market, research, rolling, signals, simulation, wallet

from .conftest import same_rows


def test_future_rows_change_no_past_answer(spark):
    rows = [("a", 1, 1, None, 0, 10), ("a", 2, 5, None, 1, 20), ("a", 2, 5, None, 2, 21), ("b", 1, 1, 3, 0, 5), ("b", 1, 9, None, 1, 6)]
    schema = "k string, eff int, known int, sup int, ord int, v int"

    def answer(data, at, known):
        df = spark.createDataFrame(data, schema)
        seen = df.where(bt.visible(F.col("eff"), F.col("known"), F.col("sup"), at, known))
        return {r.k: r.v for r in bt.latest(seen, ["k"], ["eff", "known", "ord"], ["v"]).collect()}

    assert answer(rows, 2, 5) == {"a": 21}  # b superseded at 3, its successor unknown until 9
    assert answer(rows, 2, 2) == {"a": 10, "b": 5} and answer(rows, 9, 9) == {"a": 21, "b": 6}
    assert answer([*rows, ("a", 3, 50, None, 3, 99)], 2, 5) == answer(rows, 2, 5)


def test_asof_and_interval_joins_by_hand(spark):
    rng = random.Random(1)
    left = [(i, rng.randrange(3), rng.randrange(60)) for i in range(60)]
    right = [(i, rng.randrange(3), rng.randrange(60), i * 10) for i in range(80)]
    lf, rf = spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "rid int, k int, rt int, v int")
    got = {r.id: r.v for r in bt.asof_join(lf, rf, ["k"], "t", "rt", ["v"], "rid").collect()}
    for i, k, t in left:
        ok = [(rt, rid, v) for rid, rk, rt, v in right if rk == k and rt <= t]
        assert got[i] == (max(ok)[2] if ok else None)
    near = {r.id: r.r_id for r in bt.interval_first(lf, rf.withColumnRenamed("rt", "t"), ["k"], "t", "id", "rid", 7, ["v"]).collect()}
    for i, k, t in left:
        ok = [rid for rid, rk, rt, _ in right if rk == k and 0 < rt - t <= 7]
        assert near.get(i) == (min(ok) if ok else None)
    with pytest.raises(Exception, match="no row"):
        lf.select(bt.required(F.lit(None).cast("int"), "no row")).collect()


def test_book_lookup_ties_go_to_the_first_stored_line_and_nulls_find_nothing(spark, tmp_path):
    import duckdb

    from quarrystone.plans import catalog

    con = duckdb.connect()
    con.execute("SET threads = 1")  # its arg_max then meets the lines as they are stored
    line = "SELECT {} AS l_orderkey, {} AS l_linenumber, 1 AS l_partkey, 1 AS l_suppkey, 1 AS l_quantity, {} AS l_extendedprice, 0.0 AS l_discount, 0.0 AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus, {} AS l_shipdate"
    copies = [line.format("50 * (i % 40)", "i % 3", "100.0 + i", f"TIMESTAMP '2024-01-01' + to_days(CAST(i % {m} AS INT))") + " FROM range(4000) t(i)" for m in (7, 1)]
    odd = [("7::BIGINT", 1, "5.0::DOUBLE", "NULL::TIMESTAMP"), ("7::BIGINT", 9, "NULL::DOUBLE", "TIMESTAMP '2024-01-02'"), ("7::BIGINT", 3, "6.0", "TIMESTAMP '2024-01-02'"), ("NULL::BIGINT", 1, "8.0", "TIMESTAMP '2024-01-02'"), ("9::BIGINT", 1, "NULL::DOUBLE", "TIMESTAMP '2024-01-02'")]
    (tmp_path / "lineitem.parquet").mkdir()
    for name, rows in (("b", copies[1]), ("a", copies[0]), ("c", " UNION ALL ".join(line.format(*x) for x in odd))):
        con.execute(f"COPY (SELECT * REPLACE (l_orderkey::BIGINT AS l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice::DOUBLE AS l_extendedprice) FROM ({rows})) TO '{tmp_path}/lineitem.parquet/{name}.parquet'")
    keys = "(VALUES (0), (7), (9), (11), (NULL)) k(o_orderkey), (VALUES (TIMESTAMP '2023-12-31'), ('2024-01-01'), ('2024-01-03'), ('2024-01-09'), (NULL)) d(o_orderdate)"
    con.execute(f"COPY (SELECT o_orderkey::BIGINT AS o_orderkey, o_orderdate FROM {keys}) TO '{tmp_path}/orders.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    same_rows(catalog.QUERIES["asof_book_lookup"](spark, str(tmp_path)), con, catalog.ORACLE_SQL["asof_book_lookup"])


def test_cohort_predicates_fail_closed(spark):
    df = spark.createDataFrame([(1, 5, "x"), (2, None, "x"), (3, 1, None)], "id int, skill int, seg string")
    have, seg = market.AtLeast("skill", 3), market.Equals("seg", "x")
    by = lambda p: [r[0] for r in df.orderBy("id").select(market.matches(p, "withhold")).collect()]
    assert by(market.And((have, seg))) == [True, None, False]  # the false first part of 3 decides before the missing one
    assert by(market.And((seg, have))) == [True, None, None]
    assert by(market.Or((have, seg))) == [True, True, None]
    assert by(market.Not(have)) == [False, None, True]
    with pytest.raises(Exception, match="missing"):
        df.select(market.matches(have)).collect()


def test_allocation_makes_a_million(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randrange(1, 50)) for k in range(20) for i in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "k int, i int, w bigint")
    long = {(r.k, r.i): r.ppm for r in market.allocate_ppm(df, ["k"], "w", "i").collect()}
    wide = df.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("w"))
    for r in wide.select("k", market.allocate_array(F.col("w")).alias("p")).collect():
        assert sum(r.p) == 1_000_000 and r.p == [long[r.k, i] for i in range(len(r.p))]


def test_book_golden():
    b = book.Book()
    order = lambda i, bid, p, q, t=0: {"order_id": i, "bid": bid, "price": p, "remaining": q, "time": t}
    b.snapshot(1, [order("b1", True, 99, 5), order("b2", True, 99, 5, -1), order("a1", False, 101, 4), order("a2", False, 102, 6)])
    assert b.levels(True) == [(99, 10, 2)] and [o["order_id"] for o in b.live(True)] == ["b2", "b1"]
    assert book.quote(b, True, 4)["vwap"] == 101
    with pytest.raises(ArithmeticError):
        book.quote(b, True, 7)
    with pytest.raises(ValueError):
        book.quote(b, True, 11)
    b.diff(2, "Fill", {"order_id": "a1", "quantity": 4})
    assert b.levels(False) == [(102, 6, 1)]
    b.diff(4, "Cancel", {"order_id": "a2"})
    assert (b.health, b.reason, b.orders) == ("Red", "SequenceGap", {})
    for op, reason in [(("Add", order("x", True, 102, 1)), "Crossed"), (("Add", order("b1", True, 1, 1)), "DuplicateOrder"), (("Cancel", {"order_id": "zz"}), "UnknownOrder"), (("Fill", {"order_id": "b1", "quantity": 6}), "Overfill")]:
        b.snapshot(7, [order("b1", True, 99, 5), order("a1", False, 101, 4)])
        b.diff(8, *op)
        assert b.reason == reason


def test_book_update_moves_the_price():
    b = book.Book()
    order = lambda i, bid, p, q, t=0: {"order_id": i, "bid": bid, "price": p, "remaining": q, "time": t}
    b.snapshot(1, [order("b1", True, 99, 5, 1), order("b2", True, 98, 5, 2), order("a1", False, 101, 4)])
    b.diff(2, "Update", {"order_id": "b1", "price": 98, "remaining": 3})
    assert b.levels(True) == [(98, 8, 2)] and [o["order_id"] for o in b.live(True)] == ["b1", "b2"] and b.best(True) == 98
    b.diff(3, "Update", {"order_id": "b2", "price": 100, "remaining": 1})
    assert b.levels(True) == [(100, 1, 1), (98, 3, 1)]
    b.diff(4, "Update", {"order_id": "b2", "price": 100, "remaining": 0})
    assert b.levels(True) == [(98, 3, 1)] and b.health == "Healthy"
    b.diff(5, "Update", {"order_id": "b1", "price": 101, "remaining": 1})
    assert (b.health, b.reason, b.levels(False)) == ("Red", "Crossed", [])
    b.snapshot(6, [order("b1", True, 99, 5)])
    b.diff(7, "Update", {"order_id": "b1", "price": 0, "remaining": 1})
    assert b.reason == "NonPositive"


def test_book_levels_follow_the_orders():
    rng = random.Random(3)
    b, want, seq = book.Book(), {}, 1
    b.snapshot(1, [])
    for i in range(600):
        seq += 1
        if want and rng.random() < 0.5:
            k = rng.choice(list(want))
            if rng.random() < 0.4:
                del want[k]
                b.diff(seq, "Cancel", {"order_id": k})
            else:
                bid = want[k]["bid"]
                want[k] = want[k] | {"price": rng.randrange(1, 50) + 50 * (not bid), "remaining": rng.randrange(1, 9)}
                b.diff(seq, "Update", {"order_id": k, "price": want[k]["price"], "remaining": want[k]["remaining"]})
        else:
            bid = rng.random() < 0.5
            want[f"o{i}"] = {"order_id": f"o{i}", "bid": bid, "price": rng.randrange(1, 50) + 50 * (not bid), "remaining": rng.randrange(1, 9), "time": i}
            b.diff(seq, "Add", want[f"o{i}"])
        for bids in (True, False):
            prices = sorted({o["price"] for o in want.values() if o["bid"] == bids}, reverse=bids)
            assert [p for p, *_ in b.levels(bids)] == prices and b.best(bids) == (prices[0] if prices else None)
            assert sum(q for _, q, _ in b.levels(bids)) == sum(o["remaining"] for o in want.values() if o["bid"] == bids)


def test_committed_book_and_checkpoints():
    order = {"order_id": "b1", "bid": True, "price": 99, "remaining": 5, "time": 1}
    c = book.CommittedBook(most_provisional=1)
    c.commit("s", 1, "Snapshot", [order])
    c.commit("d", 2, "Fill", {"order_id": "b1", "quantity": 2})
    c.commit("d", 2, "Fill", {"order_id": "b1", "quantity": 2})  # a repeat changes nothing
    assert c.book.orders["b1"]["remaining"] == 3
    with pytest.raises(ValueError, match="conflict"):
        c.commit("d", 2, "Fill", {"order_id": "b1", "quantity": 1})
    c.provisional("p", "x")
    c.provisional("p", "x")
    with pytest.raises(ValueError, match="conflict"):
        c.provisional("p", "y")
    with pytest.raises(ValueError, match="too many"):
        c.provisional("q", "x")
    state = book.checkpoint(c.book)
    assert book.restored(state).orders == c.book.orders and book.checkpoint(book.restored(state)) == state
    with pytest.raises(ValueError, match="digest"):
        book.restored(state | {"sequence": 9})
    with pytest.raises(ValueError, match="Red"):
        c.commit("gap", 9, "Cancel", {"order_id": "b1"})
    with pytest.raises(ValueError):
        book.checkpoint(c.book)


def test_book_replay(spark):
    rows = [("m", 0, 1, "Snapshot", "b", True, 10, 5, None, 0), ("m", 0, 1, "Snapshot", "a", False, 12, 5, None, 0), ("m", 1, 2, "Fill", "a", None, None, None, 2, None), ("m", 2, 4, "Cancel", "a", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "market string, ordinal bigint, sequence bigint, kind string, order_id string, bid boolean, price bigint, remaining bigint, quantity bigint, time bigint")
    got = book.replay(df).orderBy("ordinal", "orders").collect()
    assert [(r.health, r.best_bid, r.best_ask) for r in got][-2:] == [("Healthy", 10, 12), ("Red", None, None)]


def test_cascade_by_hand():
    rows = [{"side": 1, "notional": 1000, "distance": 90, "band": 20, "collateral": 0}, {"side": 1, "notional": 1000, "distance": 140, "band": 0, "collateral": 1}, {"side": -1, "notional": 500, "distance": 40, "band": 0, "collateral": 0}]
    got = market.cascade(rows, -100, 0, 100_000, 1_000_000, 1_000_000)
    assert (got["waves"], got["forced"], got["cumulative"]) == (2, 2000, -300)
    assert market.cascade(rows, -100, -1, 100_000, 1_000_000, 1_000_000)["waves"] == 0
    assert market.cascade([], -500, 0, 1, 1, 1)["waves"] == 0


def test_simulation_rules(spark):
    books = [{"effective": t, "known": t, "bids": [(100 + t // 10, 10), (99, 50)], "asks": [(102 + t // 10, 10), (103 + t // 10, 50)]} for t in (0, 10, 20, 30)]
    base = {
        "id": 1, "buy": True, "detected": 0, "known": 100, "latency": 5, "stale": 60, "quantity": 12, "part_ppm": 1_000_000, "bankroll": 10_000, "policy": "Market", "limit": None,
        "hold": 20, "take_profit": None, "stop": None, "fee_ppm": 1000, "slip_bps": 0, "impact_bps": 0, "funding_every": 10, "funding_ppm": 0,
    }
    r = simulation.simulate(base, books)
    assert (r["status"], r["filled"], r["entry"], r["cause"]) == ("Filled", 12, 10 * 102 + 2 * 103, "Time") and r["exit"] == 10 * 102 + 2 * 99
    assert simulation.simulate(base | {"stale": 1}, books)["status"] == "StaleBook"
    assert simulation.simulate(base | {"bankroll": 5}, books)["status"] == "Bankroll"
    assert simulation.simulate(base | {"policy": "ALO", "limit": 105}, books)["status"] == "WouldCross"
    assert simulation.simulate(base | {"policy": "IOC", "limit": 102}, books)["filled"] == 10
    assert simulation.simulate(base | {"take_profit": 101}, books)["cause"] == "TakeProfit"
    assert simulation.simulate(base | {"known": -1}, books)["status"] == "StaleBook"
    assert simulation.splitmix64(0) == 0xE220A8397B1DCDAF
    assert simulation.liquidation(6, 10, 4) == ("Exact", 15, 15) and simulation.liquidation(5, 10, 4)[0] == "Range"
    req = spark.createDataFrame([(1,)], "id bigint").selectExpr(
        "named_struct('id', 1L, 'buy', true, 'detected', 0L, 'known', 100L, 'latency', 5L, 'stale', 60L, 'quantity', 12L, 'part_ppm', 1000000L, 'bankroll', 10000L, 'policy', 'Market', 'limit', cast(null as bigint), 'hold', 20L, 'take_profit', cast(null as bigint), 'stop', cast(null as bigint), 'fee_ppm', 1000L, 'slip_bps', 0L, 'impact_bps', 0L, 'funding_every', 10L, 'funding_ppm', 0L) AS request",
        "transform(array(0L, 10L, 20L, 30L), t -> named_struct('effective', t, 'known', t, 'bids', array(named_struct('price', 100 + t div 10, 'quantity', 10L), named_struct('price', 99L, 'quantity', 50L)), 'asks', array(named_struct('price', 102 + t div 10, 'quantity', 10L), named_struct('price', 103 + t div 10, 'quantity', 50L)))) AS books",
    )
    assert simulation.run(req).first().asDict() == r


def test_research(spark):
    f = research.folds((0, 99), [(120, 139), (150, 169)], 5, 3)
    assert [(x["training_to"], x["validation_from"]) for x in f] == [(99, 120), (139, 150)]
    assert research.bootstrap([1] * 7)[0] == "Withheld" and research.bootstrap([4] * 20) == ("MeanOnly", 4, None) and research.bootstrap([3] * 40) == ("Full", 3, 3)
    rng = random.Random(4)
    xs = [rng.randrange(-50, 100) for _ in range(60)]
    assert research.bootstrap(xs) == research.bootstrap(xs) and research.bootstrap(xs)[2] <= research.bootstrap(xs)[1]
    got = research.bootstraps(spark.createDataFrame([(1, xs), (2, [1])], "key int, outcomes array<bigint>")).orderBy("key").collect()
    assert (got[0].mean, got[0].lower) == research.bootstrap(xs)[1:] and got[1].status == "Withheld"
    ev = spark.createDataFrame([(120, 100, 150_000, False, False, False), (90, 50, 300_000, True, True, True), (120, None, None, None, None, None)], "outcomes int, days int, largest_share_ppm int, as_probability boolean, shadow_live boolean, locked boolean")
    got = [[(g.gate, g.decision) for g in r.gates] for r in research.promotion(ev).collect()]
    failed = [{n for n, d in g if d == "Fail"} for g in got]
    assert [len(g) for g in got] == [12] * 3 and failed[0] == failed[2] == set()
    assert failed[1] == {"independent_outcomes", "calendar_coverage", "concentration", "calibration", "shadow_live", "locked_holdout"}
    with pytest.raises(Exception, match="twice"):
        research.registered(spark.createDataFrame([("a",), ("a",)], "experiment_id string")).collect()
    plan = research.subscriptions([(f"s{i}", 100) for i in range(25)], connections=2, messages=2000)
    assert len(plan["plan"]) == 20 and len(plan["refused"]) == 5


def test_components_and_rules(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}
    with pytest.raises(Exception, match="overfill"):
        ledger.checked(spark.createDataFrame([("overfill",), (None,)], "error string")).collect()
    rows = spark.createDataFrame([("OriginatorExposureClosed", 5), ("Custom", 5)], "kind string, x bigint")
    c = F.col("x")
    got = rows.select(signals.invalidated(F.col("kind"), c, c, c, F.lit(True), F.lit("Green"), F.lit("Green"), c, F.lit(5)).alias("s")).collect()
    assert [r.s and tuple(r.s) for r in got] == [(True, 0), None]


def test_performance_by_hand(spark):
    rows = [(1, 0, 0, 0, 100), (1, 10, 0, 1, 110), (1, 20, 1, 2, 90), (1, 30, 0, 3, 220), (2, 0, 1, 0, 5), (3, 0, 0, 0, 0)]
    got = {r.subject: r for r in wallet.performance(spark.createDataFrame(rows, "subject long, time long, kind int, ordinal long, amount long")).collect()}
    # the first observation is no new peak: the next higher one ends a drawdown of zero
    assert got[1].recovery == 10 and got[1].max_drawdown_e12 == 0
    assert got[1].twr_e12 == 210_000_000_000 and got[1].gain == 30 and got[2].twr_e12 is None and got[3].twr_e12 is None


def test_performance_recovery_from_the_first_peak(spark):
    rows = [(1, 0, 0, 0, 100), (1, 5, 0, 1, 80), (1, 9, 0, 2, 90), (1, 12, 0, 3, 101), (2, 3, 0, 0, 50), (2, 7, 0, 1, 50), (3, 0, 0, 0, 100), (3, 4, 0, 1, 90)]
    got = {r.subject: r for r in wallet.performance(spark.createDataFrame(rows, "subject long, time long, kind int, ordinal long, amount long")).collect()}
    assert [(got[k].recovery, got[k].max_drawdown_e12) for k in (1, 2, 3)] == [(12, 200_000_000_000), (None, 0), (None, 100_000_000_000)]


def test_style_and_intent_weights(spark):
    none = [F.lit(None).cast("bigint")] * 9 + [F.lit(None).cast("boolean")] * 2
    full = [F.lit(x) for x in (750_000, 900_000, 1_000_000, 800_000, 900, 0, 0, 0, 0)] + [F.lit(False), F.lit(False)]
    row = spark.range(1).select(wallet.style_weights(*none).alias("none"), wallet.style_weights(*full).alias("full")).first()
    assert row.none == [1] * 12 + [80]
    assert dict(zip(wallet.STYLES, row.full)) == dict.fromkeys(wallet.STYLES, 1) | {"MarketMaking": 66, "MeanReversion": 11, "Scalping": 51, "DirectionalDiscretionary": 26, "MomentumTrend": 16}
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    cases = [((t, t, t, t), "OpenDirectional", 41), ((f, t, t, t), "AddDirectional", 41), ((f, f, t, t), "ReduceRisk", 41), ((f, n, t, f), "CloseDirectional", 31), ((n, n, n, n), "Unknown", 70), ((n, f, f, f), None, 1)]
    for inputs, name, weight in cases:
        got = spark.range(1).select(wallet.intent_weights(*inputs, f, f, f, f, f).alias("w")).first().w
        assert dict(zip(wallet.INTENTS, got)) == dict.fromkeys(wallet.INTENTS, 1) | ({name: weight} if name else {})


def test_change_points(spark):
    rows = [(1, i, 100_000 if i < 20 else 800_000) for i in range(40)]
    start, step = rolling.cusum(50_000, 600_000, 3)
    out = rolling.fold(spark.createDataFrame(rows, "key long, ordinal long, x long"), ["key"], ["ordinal"], "key long, ordinal long, regime long, mean long", start, step)
    assert [(r.ordinal, r.regime) for r in out.orderBy("ordinal").collect()] == [(0, 1), (20, 2)]


def test_regime_dwell(spark):
    up, quiet = [1, 1, 30, 1, 1, 1, 1, 1], [40, 1, 1, 1, 1, 1, 1, 1]
    rows = [(1, 0, 0, up), (1, 100, 1, quiet), (1, 1000, 2, quiet), (1, 2000, 3, [])]
    df = spark.createDataFrame(rows, "key long, known long, ordinal long, weights array<long>")
    got = {r.ordinal: r for r in market.regime_path(df, dwell=300).collect()}
    assert [got[i].dominant for i in range(4)] == ["OrderlyUp", "OrderlyUp", "QuietRange", "Unsupported"]
    boosted = market.shares_of(quiet)
    boosted[2] += market.shares_of(up)[2] + 200_000
    assert list(got[1].ppm) == market.shares_of(boosted) and got[3].change == 1_000_000 and all(sum(r.ppm) == 1_000_000 for r in got.values())


def test_contributing_dimensions(spark):
    big = 2**63 - 1
    rows = [([1, 5, 0, -9, 4], [1, 0, 5, 0, 3], [3, 1, 2]), ([0, 0, 0, 0], [0, 0, 0, 0], [0, 1, 2]), ([1, big, 2, 3], [0, -big - 1, 2, 8], [1, 3, 0]), ([7, 1], [7, 2], [1, 0])]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, want array<int>")
    for r in df.withColumn("got", market.contributing_dimensions("a", "b")).collect():
        assert r.got == r.want
