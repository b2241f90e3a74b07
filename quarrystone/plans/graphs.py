"""Entity graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import product_ppm, trunc_div
from ..operators import bitemporal as bt
from ..operators import graph
from .registry import EV, LI, events, lines, micros, query, table


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey + 7 AS b FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_custkey + 7 IN (SELECT c_custkey FROM customer)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS reach FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.reach = u.a)
SELECT node, min(reach) AS component FROM r GROUP BY node""")
def administrative_groups(spark, d):
    """Connected components over identity links."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    e = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 7).alias("b"))
    return graph.components(e.join(c.withColumnRenamed("c_custkey", "b"), "b", "left_semi"))


LAG = 1_800_000_000


@query(f"""WITH {EV}, l AS (SELECT *, user_id % 10 AS pool FROM ev WHERE event_type = 'click'), f AS (SELECT *, user_id % 10 AS pool FROM ev WHERE event_type = 'purchase'),
m AS (SELECT l.user_id AS leader, f.user_id AS follower, f.us - l.us AS lag, (l.cents - f.cents) % 2 = 0 AS same, abs(l.cents - f.cents) % 10 < 5 AS small
  FROM l JOIN f ON l.pool = f.pool AND f.us > l.us AND f.us - l.us <= {LAG} QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY f.event_id) = 1),
a AS (SELECT leader, follower, count(*) FILTER (same) AS sim, count(*) FILTER (NOT same) AS contrarian, count(*) FILTER (same AND small) AS sm, list_sort(list(lag)) AS lags FROM m GROUP BY ALL),
n AS (SELECT user_id AS leader, count(*) AS n FROM l GROUP BY 1),
p AS (SELECT *, sim * 1000000 // n AS p, lags[len(lags) // 2 + 1] AS lag FROM a JOIN n USING (leader))
SELECT leader, follower, n, sim AS "similar", p AS probability_ppm, lag AS median_lag, CASE WHEN sim > 0 AND sm * 2 < sim THEN 'IndependentConfirmer' WHEN sim = 0 AND contrarian * 2 >= n THEN 'Contrarian'
 WHEN p >= 800000 AND lag <= 150000000 THEN 'CopyBot' WHEN p >= 600000 AND lag <= 600000000 THEN 'FastFollower' WHEN p >= 600000 THEN 'SlowFollower' WHEN p >= 400000 THEN 'IndependentConfirmer' ELSE 'NoStableRelation' END AS class FROM p""")
def relationship_edges(spark, d):
    """Class of each leader/follower pair from its matched actions."""
    ev = events(spark, d).withColumn("pool", F.col("user_id") % 10)
    lead = ev.where("event_type = 'click'")
    m = bt.interval_first(lead, ev.where("event_type = 'purchase'"), ["pool"], "us", "event_id", "event_id", LAG, ["user_id", "cents"])
    m = m.join(lead.select("event_id", F.col("user_id").alias("leader"), "cents"), "event_id")
    same = (F.col("cents") - F.col("r_cents")) % 2 == 0
    m = m.select("leader", F.col("r_user_id").alias("follower"), "lag", same.alias("same"), (~same).alias("opposite"), (F.abs(F.col("cents") - F.col("r_cents")) % 10 < 5).alias("small_move"))
    n = lead.groupBy(F.col("user_id").alias("leader")).agg(F.count(F.lit(1)).alias("n"))
    return graph.relations(m, n, ["leader", "follower"], 600_000_000)


@query(f"""WITH {LI}, t AS (SELECT least(l_suppkey % 10, l_partkey % 10) AS a, greatest(l_suppkey % 10, l_partkey % 10) AS b, l_suppkey % 10 AS taker, disc - 500 AS markout, tax AS market FROM li WHERE l_suppkey % 10 <> l_partkey % 10)
SELECT a, b, count(*) AS n, CAST(sum((CASE WHEN taker = a THEN markout ELSE -markout END) - market) AS BIGINT) // count(*) AS residual, CAST(coalesce(sum(-markout) FILTER (taker <> a), 0) AS BIGINT) // count(*) AS adverse FROM t GROUP BY ALL""")
def counterparty_summary(spark, d):
    """Markouts between unordered account pairs."""
    t = lines(spark, d).select((F.col("l_suppkey") % 10).alias("taker"), (F.col("l_partkey") % 10).alias("maker"), (F.col("disc") - 500).alias("markout"), F.col("tax").alias("market"))
    t = t.where("taker <> maker").withColumn("a", F.least("taker", "maker")).withColumn("b", F.greatest("taker", "maker"))
    signed = F.when(F.col("taker") == F.col("a"), F.col("markout")).otherwise(-F.col("markout"))
    agg = t.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(signed - F.col("market")).alias("r"), F.coalesce(F.sum(F.when(F.col("taker") != F.col("a"), -F.col("markout"))), F.lit(0)).alias("adv"))
    return agg.select("a", "b", "n", trunc_div("r", "n").alias("residual"), trunc_div("adv", "n").alias("adverse"))


@query(f"""WITH {EV}, w AS (SELECT user_id % 20 AS market, ((900000 - event_id % 7 * 100000) * (400000 + event_id % 5 * 150000) // 1000000) AS w FROM ev)
SELECT market, (CAST(sum(w) AS BIGINT) + 500000) // 1000000 AS votes FROM w GROUP BY 1""")
def independent_votes(spark, d):
    """Independence weights as a truncated product; votes rounded half up."""
    w = product_ppm(F.expr("900000 - event_id % 7 * 100000"), F.expr("400000 + event_id % 5 * 150000"))
    return events(spark, d).groupBy((F.col("user_id") % 20).alias("market")).agg(F.sum(w).alias("w")).select("market", graph.effective_votes(F.col("w")).alias("votes"))


@query("""WITH f AS (SELECT o_custkey, list_sort(list(DISTINCT CASE o_orderpriority WHEN '1-URGENT' THEN 'Hard' ELSE o_orderpriority END)) AS fam, max(o_orderkey * 7919 % 1000000) AS posterior FROM orders GROUP BY 1)
SELECT o_custkey, len(list_filter(fam, lambda x: x <> 'Hard')) >= 2 AND posterior >= 800000 AS merge FROM f""")
def soft_merges(spark, d):
    fam = F.collect_set(F.expr("if(o_orderpriority = '1-URGENT', 'Hard', o_orderpriority)")).alias("fam")
    t = table(spark, d, "orders").groupBy("o_custkey").agg(fam, F.max(F.expr("o_orderkey * 7919 % 1000000")).alias("posterior"))
    return t.select("o_custkey", graph.soft_merge(F.col("fam"), F.col("posterior")).alias("merge"))


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, o_custkey % 2 AS hard, o_orderkey * 31 % 1000001 AS p, o_custkey, o_orderkey % 1500 AS other FROM orders) WHERE o_custkey = other OR (hard = 1 AND p < 500000)""")
def invalid_links(spark, d):
    """Links that break a rule: self-loops, hard links without certainty."""
    t = table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey % 2 AS hard", "o_orderkey * 31 % 1000001 AS p", "o_custkey", "o_orderkey % 1500 AS other")
    return t.where((F.col("o_custkey") == F.col("other")) | ((F.col("hard") == 1) & (F.col("p") < 500_000))).select("o_orderkey")


@query("""SELECT o_custkey AS account, o_orderkey % 11 AS validator, min(o_orderkey) AS first_height, max(o_orderkey) AS last_height, CAST(sum(CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 2 END) AS BIGINT) AS amount FROM orders GROUP BY ALL""")
def delegation_ranges(spark, d):
    """First and last height and standing amount of each account's delegation to a validator."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("account"), (F.col("o_orderkey") % 11).alias("validator"), F.col("o_orderkey").alias("height"))
    amount = F.sum(F.when(F.col("height") % 4 == 0, -1).otherwise(2))
    return o.groupBy("account", "validator").agg(F.min("height").alias("first_height"), F.max("height").alias("last_height"), amount.alias("amount"))


@query("""WITH t AS (SELECT o_orderkey AS height, epoch_us(o_orderdate) AS time FROM orders), s AS (SELECT c_custkey AS a, c_custkey + 1000000 AS b, min(o_orderkey) AS h FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 3 = 0 GROUP BY 1, 2),
v AS (SELECT c_custkey AS a, -c_nationkey - 1 AS b, max(o_orderkey) AS h FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 5 = 0 GROUP BY 1, 2)
SELECT a, b, 'ProtocolSubaccount' AS kind, 1000000 AS posterior_ppm, time AS effective_at FROM s JOIN t ON h = height UNION ALL SELECT a, b, 'ProtocolVaultMembership', 1000000, time FROM v JOIN t ON h = height""")
def emitted_links(spark, d):
    """Links that state proves: subaccounts and vault memberships, dated by their first block."""
    o = table(spark, d, "orders")
    first = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    c = table(spark, d, "customer").join(first, "c_custkey")
    sub = c.where("c_custkey % 3 = 0").selectExpr("c_custkey AS master", "c_custkey + 1000000 AS subaccount", "lo AS first_height")
    vault = c.where("c_custkey % 5 = 0").selectExpr("c_custkey AS account", "cast(-c_nationkey - 1 as bigint) AS vault", "hi AS first_height")
    return graph.emitted_links(sub, vault, o.select(F.col("o_orderkey").alias("height"), micros("o_orderdate").alias("time")))
