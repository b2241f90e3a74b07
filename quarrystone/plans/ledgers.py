"""Ledger, order-book, margin and signal queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ledger, signals
from ..streaming import lanes
from .registry import EV, LI, cents, days, events, lines, query, table


@query(f"""WITH {LI}, f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, px, qty, sum(qty) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, px ROWS UNBOUNDED PRECEDING) AS filled FROM li)
SELECT l_orderkey, l_linenumber, l_partkey, qty, CAST(filled AS BIGINT) AS filled, CAST(100 + o_orderkey % 60 - filled AS BIGINT) AS remaining,
CASE WHEN o_orderkey IS NULL THEN 'unknown order' WHEN filled > 100 + o_orderkey % 60 THEN 'overfill' WHEN qty <= 0 THEN 'non-positive fill' END AS error FROM f LEFT JOIN orders ON l_orderkey = o_orderkey""")
def order_lifecycle_fill_check(spark, d):
    """Running fills against the accepted quantity of each order."""
    accepted = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 60 + 100).alias("accepted"))
    out = ledger.order_fills(lines(spark, d), accepted, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "px"], "qty", "accepted")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "qty", "filled", "remaining", "error")


@query(f"""WITH {EV}, t AS (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN cents ELSE -cents END AS sg FROM ev),
r AS (SELECT *, sum(sg) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS result FROM t), s AS (SELECT *, result - sg AS start FROM r),
n AS (SELECT *, sum(CASE WHEN (start = 0 AND result <> 0) OR sign(start) * sign(result) < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS n FROM s)
SELECT event_id, 0 AS leg, CAST(CASE WHEN sign(start) * sign(result) < 0 THEN n - 1 ELSE n END AS BIGINT) AS episode, CAST(CASE WHEN sign(start) * sign(result) < 0 THEN -start ELSE sg END AS BIGINT) AS leg_qty,
 CASE WHEN sign(start) * sign(result) < 0 THEN 'TradeReversal' WHEN result = 0 THEN 'TradeFlat' WHEN start = 0 THEN 'Open' ELSE 'Update' END AS reason FROM n
UNION ALL SELECT event_id, 1, CAST(n AS BIGINT), CAST(result AS BIGINT), 'Open' FROM n WHERE sign(start) * sign(result) < 0""")
def position_episodes(spark, d):
    """Position episodes with reversals split into two legs."""
    t = events(spark, d).withColumn("sg", F.when(F.col("event_type").isin("click", "view"), F.col("cents")).otherwise(-F.col("cents")))
    return ledger.episodes(t, ["user_id"], ["us", "event_id"], "sg").select("event_id", "leg", "episode", "leg_qty", "reason")


STATES = "CASE event_type WHEN 'signup' THEN 'Accepted' WHEN 'view' THEN 'Rested' WHEN 'click' THEN 'PartiallyFilled' WHEN 'purchase' THEN 'Filled' ELSE 'Cancelled' END"
LEGAL = ", ".join(f"'{a}>{b}'" for a, b in ledger.ORDER_EDGES)


@query(f"""WITH {EV}, s AS (SELECT *, {STATES} AS state FROM ev), p AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY us, event_id) AS previous FROM s)
SELECT event_id, state, previous, coalesce(previous, 'none') || '>' || state IN ({LEGAL}) AS legal FROM p""")
def lifecycle_fold(spark, d):
    """Legality of each state move of a key's event chain."""
    s = events(spark, d).withColumn("state", F.expr(STATES))
    return ledger.transitions(s, ["user_id"], ["us", "event_id"], "state", ledger.ORDER_EDGES).select("event_id", "state", "previous", "legal")


@query(f"""WITH {EV}, l AS (
 SELECT user_id AS account, 'perp' AS scope, cents AS delta FROM ev WHERE event_type = 'signup' UNION ALL SELECT user_id, 'perp', -cents FROM ev WHERE event_type = 'purchase'
 UNION ALL SELECT user_id, 'perp', -cents FROM ev WHERE event_type = 'click' UNION ALL SELECT event_id % 50, 'perp', cents FROM ev WHERE event_type = 'click'
 UNION ALL SELECT user_id, 'spot', cents FROM ev WHERE event_type = 'view' UNION ALL SELECT user_id, 'perp', -cents FROM ev WHERE event_type = 'view' UNION ALL SELECT user_id, 'fee', -cents FROM ev WHERE event_type = 'error')
SELECT account, scope, CAST(sum(greatest(delta, 0)) AS BIGINT) AS credit, CAST(sum(greatest(-delta, 0)) AS BIGINT) AS debit, CAST(sum(delta) AS BIGINT) AS net FROM l GROUP BY ALL""")
def account_flows(spark, d):
    """Credits and debits of each account and scope from signed legs."""
    ev = events(spark, d).withColumn("other", F.col("event_id") % 50)
    rules = {
        "signup": [("user_id", "perp", 1)], "purchase": [("user_id", "perp", -1)], "click": [("user_id", "perp", -1), ("other", "perp", 1)],
        "view": [("user_id", "spot", 1), ("user_id", "perp", -1)], "error": [("user_id", "fee", -1)],
    }
    return ledger.balances(ledger.signed_legs(ev, rules, "event_type", "cents"))


@query(f"""WITH {EV}, s AS (SELECT user_id, event_id % 7 AS validator, CASE event_type WHEN 'signup' THEN cents ELSE 0 END AS deposit, CASE event_type WHEN 'view' THEN cents ELSE 0 END AS delegate, CASE event_type WHEN 'click' THEN cents ELSE 0 END AS undelegate FROM ev)
SELECT user_id, CAST(sum(deposit - delegate + undelegate) AS BIGINT) AS liquid, CAST(sum(delegate - undelegate) AS BIGINT) AS delegated, sum(delegate - undelegate) < 0 AS overdrawn FROM s GROUP BY 1""")
def staking_balances(spark, d):
    """Liquid and delegated stake; more debits than credits is an error state."""
    amount = lambda kind: F.when(F.col("event_type") == kind, F.col("cents")).otherwise(0)
    t = events(spark, d).groupBy("user_id").agg(F.sum(amount("signup") - amount("view") + amount("click")).alias("liquid"), F.sum(amount("view") - amount("click")).alias("delegated"))
    return t.withColumn("overdrawn", F.col("delegated") < 0)


@query(f"""WITH {LI} SELECT l_partkey % 100 AS market, l_linestatus AS side, px // 100000 AS price, CAST(sum(qty) AS BIGINT) AS qty, count(*) AS orders FROM li GROUP BY ALL""")
def l2_from_l4(spark, d):
    """Book levels from resting orders."""
    li = lines(spark, d).select((F.col("l_partkey") % 100).alias("market"), F.col("l_linestatus").alias("side"), F.expr("px div 100000").alias("price"), "qty")
    return li.groupBy("market", "side", "price").agg(F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("orders"))


@query(f"""WITH {LI}, l AS (SELECT l_partkey % 100 AS market, px // 100000 AS price, sum(qty) AS qty FROM li WHERE l_linestatus = 'O' GROUP BY ALL),
w AS (SELECT *, least(greatest(2000 - coalesce(sum(qty) OVER (PARTITION BY market ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), qty) AS take FROM l)
SELECT market, CAST(sum(take) AS BIGINT) AS filled, CAST(sum(take * price) AS BIGINT) AS notional, max(price) FILTER (take > 0) AS worst, CAST(sum(take * price) AS BIGINT) * 10000 // CAST(sum(take) AS BIGINT) AS vwap_e4, sum(take) < 2000 AS short FROM w GROUP BY market""")
def depth_walk_vwap(spark, d):
    """Fill, VWAP and worst level of buying 2000 from the ask side of each market."""
    li = lines(spark, d).where("l_linestatus = 'O'").select((F.col("l_partkey") % 100).alias("market"), F.expr("px div 100000").alias("price"), "qty")
    lv = li.groupBy("market", "price").agg(F.sum("qty").alias("qty"))
    w = ledger.depth_walk(lv, ["market"], [F.col("price")], "qty", F.lit(2000).cast("bigint"))
    t = w.groupBy("market").agg(F.sum("take").alias("filled"), F.sum(F.col("take") * F.col("price")).alias("notional"), F.max(F.when(F.col("take") > 0, F.col("price"))).alias("worst"))
    return t.withColumn("vwap_e4", F.expr("notional * 10000 div filled")).withColumn("short", F.col("filled") < 2000)


@query(f"""WITH {LI}, p AS (SELECT l_suppkey, qty * (900 + l_partkey % 1000) AS notional, l_linenumber % 2 = 0 AS long, 100 + tax AS rate, qty * 40 AS collateral FROM li),
m AS (SELECT *, notional * rate // 10000 AS m FROM p),
t AS (SELECT l_suppkey, count(*) AS positions, CAST(sum(m) AS BIGINT) AS cross_, CAST(greatest(coalesce(sum(m) FILTER (long), 0), coalesce(sum(m) FILTER (NOT long), 0)) AS BIGINT) AS unified, CAST(sum(collateral) AS BIGINT) AS collateral FROM m GROUP BY 1)
SELECT l_suppkey, positions, cross_ AS "cross", unified, collateral, CASE WHEN cross_ = 0 THEN 'Safe' WHEN collateral < cross_ THEN 'Below' ELSE 'Above' END AS state FROM t""")
def margin_models(spark, d):
    """Cross and unified maintenance of each account."""
    p = lines(spark, d).select("l_suppkey", F.expr("qty * (900 + l_partkey % 1000)").alias("notional"), (F.col("l_linenumber") % 2 == 0).alias("long"), (F.col("tax") + 100).alias("rate"), (F.col("qty") * 40).alias("collateral"))
    return ledger.margin(p, ["l_suppkey"], "notional", "long", "rate", "collateral")


@query("""SELECT p_partkey, c, m, CASE WHEN c * 1000 % m = 0 THEN c * 1000 // m END AS exact_price, c * 1000 % m = 0 AS exact FROM (SELECT p_partkey, p_partkey * 13 % 997 + 1 AS c, p_size AS m FROM part)""")
def liquidation_price(spark, d):
    """Price where maintenance equals collateral: exact or a range."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 13 % 997 + 1).alias("c"), F.col("p_size").alias("m"))
    exact = F.expr("c * 1000 % m = 0")
    return p.select("p_partkey", "c", "m", F.when(exact, F.expr("c * 1000 div m")).alias("exact_price"), exact.alias("exact"))


@query(f"""WITH {EV}, k AS (SELECT event_id, user_id, us, event_type, sha256(user_id::VARCHAR || '|' || event_type || '|' || (cents % 3)::VARCHAR) AS dedup_key FROM ev),
r AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY us, event_id) AS rn FROM k) SELECT event_id, dedup_key FROM r WHERE rn = 1""")
def dedup_signals(spark, d):
    """First signal of each dedup key."""
    k = events(spark, d).withColumn("dedup_key", signals.dedup_key(F.col("user_id"), F.col("event_type"), F.col("cents") % 3))
    return k.groupBy("dedup_key").agg(F.min(F.struct("us", "event_id")).alias("m")).select("m.event_id", "dedup_key")


@query(f"""WITH {EV}, a AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS elapsed,
 count(*) OVER (PARTITION BY user_id, us // 86400000000 ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS emitted FROM ev)
SELECT event_id, CASE WHEN event_type = 'error' OR cents > 20000 THEN 'AlwaysEmit' WHEN NOT cents % 4 = 0 AND coalesce(elapsed < 3600000000, false) THEN 'Cooldown' WHEN NOT cents % 4 = 0 AND emitted >= 3 THEN 'Budget' ELSE 'Emit' END AS decision FROM a""")
def alert_policy(spark, d):
    """Emit, cooldown or budget decision of each update."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    day = Window.partitionBy("user_id", F.expr("us div 86400000000")).orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    a = events(spark, d).withColumn("elapsed", F.col("us") - F.lag("us").over(w)).withColumn("emitted", F.count(F.lit(1)).over(day))
    state = F.when(F.col("event_type") == "error", "Expired").otherwise("Live")
    return a.select("event_id", signals.alert(state, F.col("cents") % 4 == 0, F.col("elapsed"), F.col("emitted"), F.col("cents") > 20_000, 3_600_000_000, 3).alias("decision"))


@query("""WITH s AS (SELECT c_custkey, c_custkey % 7 AS votes, c_custkey * 17 % 300 AS accel, c_custkey * 13 % 60 AS markout, c_custkey % 5 - 1 AS capacity, c_custkey * 7919 % 1000000 AS crowding, c_custkey * 3 % 40 AS cost, c_custkey % 9 = 0 AS followers FROM customer)
SELECT c_custkey, list_filter([CASE WHEN votes < 3 THEN 'votes' END, CASE WHEN accel < 100 THEN 'acceleration' END, CASE WHEN markout < 20 THEN 'markout' END, CASE WHEN capacity <= 0 THEN 'capacity' END,
 CASE WHEN crowding > 600000 THEN 'crowding' END, CASE WHEN cost >= 20 THEN 'cost' END, CASE WHEN followers THEN 'followers' END], lambda x: x IS NOT NULL) AS reasons FROM s""")
def signal_acceleration(spark, d):
    """Reasons that withhold the acceleration signal."""
    k = F.col("c_custkey")
    r = signals.acceleration(k % 7, k * 17 % 300, k * 13 % 60, k % 5 - 1, k * 7919 % 1000000, k * 3 % 40, k % 9 == 0)
    return table(spark, d, "customer").select("c_custkey", r.alias("reasons"))


@query("""WITH s AS (SELECT c_custkey, c_custkey % 7 AS votes, c_custkey * 37 % 9001 - 4500 AS smart, c_custkey * 91 % 9001 - 4500 AS crowd FROM customer)
SELECT c_custkey, list_filter([CASE WHEN votes < 3 THEN 'votes' END, CASE WHEN sign(smart) * sign(crowd) >= 0 THEN 'sign' END, CASE WHEN abs(smart) < 1000 OR abs(crowd) < 1000 THEN 'size' END,
 CASE WHEN c_custkey % 8 = 0 THEN 'explained' END, CASE WHEN c_custkey % 9 = 0 THEN 'followers' END], lambda x: x IS NOT NULL) AS reasons, CASE WHEN smart > 0 THEN 'Long' ELSE 'Short' END AS direction FROM s""")
def signal_divergence(spark, d):
    k = F.col("c_custkey")
    smart, crowd = k * 37 % 9001 - 4500, k * 91 % 9001 - 4500
    r = signals.divergence(k % 7, smart, crowd, k % 8 == 0, k % 9 == 0)
    return table(spark, d, "customer").select("c_custkey", r.alias("reasons"), F.when(smart > 0, "Long").otherwise("Short").alias("direction"))


@query("""WITH s AS (SELECT c_custkey, c_custkey * 37 % 401 - 200 AS low, c_custkey * 53 % 401 - 200 AS base, c_custkey * 71 % 401 - 200 AS high, c_custkey * 7919 % 5000 AS absorbed, c_custkey * 104729 % 5000 AS forced, c_custkey % 4 AS waves FROM customer)
SELECT c_custkey, list_filter([CASE WHEN abs(base - greatest(high, low)) < 25 THEN 'flat' END, CASE WHEN absorbed >= forced THEN 'absorbed' END, CASE WHEN waves = 0 THEN 'waves' END], lambda x: x IS NOT NULL) AS reasons,
CASE WHEN base > greatest(high, low) THEN 'Short' ELSE 'Long' END AS direction FROM s""")
def signal_asymmetry(spark, d):
    """Reasons that withhold the fragility-asymmetry signal, and its direction."""
    k = F.col("c_custkey")
    low, base, high = k * 37 % 401 - 200, k * 53 % 401 - 200, k * 71 % 401 - 200
    r = signals.asymmetry(low, base, high, k * 7919 % 5000, k * 104729 % 5000, k % 4)
    return table(spark, d, "customer").select("c_custkey", r.alias("reasons"), F.when(base > F.greatest(high, low), "Short").otherwise("Long").alias("direction"))


@query("""WITH s AS (SELECT c_custkey AS k FROM customer)
SELECT k AS c_custkey, CAST((k * 31 % 200 * (k * 7919 % 1000001) * (CASE WHEN k % 5 > 0 THEN 1000000 ELSE 0 END) // 1000000) * (CASE WHEN k % 3 = 0 THEN 500000 ELSE 1000000 END) // 1000000 - k * 13 % 700000 - abs(k % 60 - 30) * 1000 - (CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 50000 WHEN 2 THEN 250000 ELSE 400000 END) AS BIGINT) AS utility FROM s""")
def signal_utility(spark, d):
    k = F.col("c_custkey")
    u = signals.utility(
        k * 31 % 200, k * 7919 % 1000001, k % 5 > 0, F.when(k % 3 == 0, 500_000).otherwise(1_000_000), k * 13 % 700000, k % 60 - 30,
        F.when(k % 4 == 0, 0).when(k % 4 == 1, 50_000).when(k % 4 == 2, 250_000).otherwise(400_000),
    )
    return table(spark, d, "customer").select("c_custkey", u.alias("utility"))


@query(f"""WITH {LI}, r AS (SELECT l_orderkey AS block, l_linenumber % 3 AS tx, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_linenumber, l_partkey, l_suppkey, px) - 1 AS idx, l_partkey FROM li),
x AS (SELECT block, tx, CASE WHEN l_partkey % 50 = 0 THEN idx + 1 ELSE idx END AS idx FROM r), y AS (SELECT block, tx, idx, row_number() OVER (PARTITION BY block, tx ORDER BY idx) - 1 AS i FROM x)
SELECT block, count(*) AS events, count(*) FILTER (i <> idx) AS bad_index, count(DISTINCT tx) AS transactions FROM y GROUP BY 1""")
def block_validity(spark, d):
    """Blocks whose event indices do not run from zero without a gap."""
    w = Window.partitionBy("l_orderkey", F.col("l_linenumber") % 3).orderBy("l_linenumber", "l_partkey", "l_suppkey", "px")
    r = lines(spark, d).withColumn("idx", F.row_number().over(w) - 1)
    x = r.select(F.col("l_orderkey").alias("block"), (F.col("l_linenumber") % 3).alias("tx"), F.when(F.col("l_partkey") % 50 == 0, F.col("idx") + 1).otherwise(F.col("idx")).alias("idx"))
    return ledger.block_errors(x)


@query("""SELECT o_custkey, max(o_orderkey) AS event_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS mode, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS leverage FROM orders GROUP BY 1""")
def account_modes(spark, d):
    """The mode in force of each account: the last change wins."""
    last = F.struct("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("event_id"), F.max_by("o_orderstatus", last).alias("mode"), F.max_by("o_orderpriority", last).alias("leverage"))


@query("""SELECT o_orderkey, (to_days - from_days) // 8 * (o_orderkey % 100 - 50) AS funding FROM (SELECT o_orderkey, epoch_us(o_orderdate) // 86400000000 AS from_days, epoch_us(o_orderdate) // 86400000000 + o_orderkey % 40 AS to_days FROM orders)""")
def funding_over_hold(spark, d):
    """Whole funding intervals inside a hold times the payment."""
    o = table(spark, d, "orders").select("o_orderkey", days("o_orderdate").alias("opened"), (days("o_orderdate") + F.col("o_orderkey") % 40).alias("closed"))
    return o.select("o_orderkey", F.expr("(closed - opened) div 8 * (o_orderkey % 100 - 50)").alias("funding"))


@query("""WITH o AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS x FROM orders), e AS (SELECT o_orderkey, [ {'at': o_orderkey % 97 + 1, 'why': 'Time'}, {'at': o_orderkey % 89 + 1, 'why': 'Invalidation'}, {'at': x % 83 + 1, 'why': 'TakeProfit'}, {'at': x % 79 + 1, 'why': 'Stop'} ] AS c FROM o)
SELECT o_orderkey, list_min(list_transform(c, lambda z: z.at)) AS at, list_filter(c, lambda z: z.at = list_min(list_transform(c, lambda y: y.at)))[1].why AS why FROM e""")
def exit_choice(spark, d):
    """The earliest of time, invalidation, take profit and stop; ties keep that order."""
    o = table(spark, d, "orders").withColumn("x", cents("o_totalprice"))
    case = lambda e, i, why: F.struct(F.expr(e).alias("at"), F.lit(i).alias("i"), F.lit(why).alias("why"))
    best = F.array_min(F.array(case("o_orderkey % 97 + 1", 0, "Time"), case("o_orderkey % 89 + 1", 1, "Invalidation"), case("x % 83 + 1", 2, "TakeProfit"), case("x % 79 + 1", 3, "Stop")))
    return o.select("o_orderkey", best.alias("b")).select("o_orderkey", "b.at", "b.why")


KINDS = "CASE WHEN event_type = 'signup' THEN 'Trade' WHEN event_type = 'error' THEN 'LiquidationFill' WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN 'BackstopLiquidation' WHEN event_type = 'purchase' THEN 'PositionSettled' WHEN event_id % 5 = 0 THEN 'Anchor' ELSE 'Trade' END"


@query(f"""WITH RECURSIVE {EV}, o AS (SELECT user_id AS key, event_id AS ordinal, {KINDS} AS kind, CASE WHEN {KINDS} IN ('Trade', 'Anchor') THEN cents - 5000 ELSE cents END AS amount, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM ev),
p AS (SELECT DISTINCT key, CAST(-1 AS BIGINT) AS ordinal, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS q, CAST(NULL AS VARCHAR) AS close_cause, CAST(NULL AS VARCHAR) AS error FROM o UNION ALL
 SELECT o.key, o.ordinal, o.n,
  CASE kind WHEN 'Anchor' THEN amount WHEN 'Trade' THEN q + amount WHEN 'BackstopLiquidation' THEN NULL
   WHEN 'LiquidationFill' THEN CASE WHEN q = 0 OR abs(q) < amount THEN q WHEN q > 0 THEN q - amount ELSE q + amount END
   ELSE CASE WHEN q = 0 OR abs(q) < amount THEN NULL WHEN q > 0 THEN q - amount ELSE q + amount END END,
  CASE WHEN kind = 'BackstopLiquidation' AND coalesce(q <> 0, true) THEN 'BackstopInterrupted' WHEN kind = 'LiquidationFill' AND q <> 0 AND abs(q) = amount THEN 'Liquidation' WHEN kind = 'PositionSettled' AND q <> 0 AND abs(q) = amount THEN 'Settlement' END,
  CASE WHEN kind = 'LiquidationFill' AND (q = 0 OR abs(q) < amount) THEN 'fill_overrun' END
 FROM p JOIN o ON o.key = p.key AND o.n = p.n + 1)
SELECT key, ordinal, q AS quantity, CASE WHEN q IS NULL THEN 'Ambiguous' WHEN q = 0 THEN 'Flat' ELSE 'Open' END AS state, close_cause, error FROM p WHERE n > 0""")
def nontrade_positions(spark, d):
    """Positions under trades, liquidation fills, backstops, settlements and anchors."""
    amount = F.when(F.expr(KINDS).isin("Trade", "Anchor"), F.col("cents") - 5000).otherwise(F.col("cents"))
    ev = events(spark, d).select(F.col("user_id").alias("key"), "us", F.col("event_id").alias("ordinal"), F.expr(KINDS).alias("kind"), amount.alias("amount"), F.col("event_id").alias("fact"))
    return ledger.nontrade_positions(ev)


@query(f"""WITH {EV}, h AS (SELECT event_id, user_id % 10 AS chain, us, event_id * 7919 % 1009 AS height FROM ev), m AS (SELECT *, max(height) OVER (PARTITION BY chain ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS watermark FROM h)
SELECT event_id, chain, height, watermark, CASE WHEN watermark IS NULL OR height > watermark THEN 'PublishProvisional' ELSE 'Retained' END AS decision FROM m""")
def provisional_watermark(spark, d):
    """Provisional heights: published above the watermark, gaps allowed, else held against what is kept."""
    ev = events(spark, d).select("event_id", (F.col("user_id") % 10).alias("chain"), "us", F.expr("event_id * 7919 % 1009").alias("height"))
    return lanes.provisional_watermark(ev, "chain", ["us", "event_id"], "height").drop("us")


@query("""WITH p AS (SELECT o_custkey % 7 AS chain, o_orderkey AS height, o_custkey AS digest FROM orders WHERE o_orderkey % 1013 <> 0 OR o_custkey % 7 = 3), i AS (SELECT o_custkey % 7 AS chain, o_orderkey AS height, o_custkey AS digest FROM orders WHERE o_orderkey % 3 <> 0),
f AS (SELECT chain, min(height) AS failover_height FROM i WHERE (chain, height) NOT IN (SELECT chain, height FROM p) GROUP BY 1)
SELECT chain, height, digest, 'primary' AS source, failover_height FROM p LEFT JOIN f USING (chain) WHERE failover_height IS NULL OR height < failover_height
UNION ALL SELECT chain, height, digest, 'independent', failover_height FROM i JOIN f USING (chain) WHERE height >= failover_height""")
def source_failover(spark, d):
    """One-way failover of each chain's blocks from the primary to the independent source."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 7).alias("chain"), F.col("o_orderkey").alias("height"), F.col("o_custkey").alias("digest"))
    return lanes.failed_over(o.where("height % 1013 <> 0 or chain = 3"), o.where("height % 3 <> 0"), "chain", "height")
