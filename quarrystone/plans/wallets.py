"""Wallet intelligence queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.fixed import PPM, trunc_div
from ..operators import market, wallet
from .registry import EV, LI, cents, days, events, lines, query, table


@query(f"""WITH {LI}, g AS (SELECT l_suppkey, l_returnflag, CAST(sum(px * (CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END)) AS BIGINT) AS v FROM li GROUP BY ALL),
s AS (SELECT l_suppkey, CAST(abs(v) AS HUGEINT) * 1000000 // CAST(sum(abs(v)) OVER (PARTITION BY l_suppkey) AS BIGINT) AS s FROM g)
SELECT l_suppkey, CAST(sum(s * s // 1000000) AS BIGINT) AS hhi_ppm, CAST(max(s) AS BIGINT) AS best_ppm FROM s GROUP BY 1""")
def concentration(spark, d):
    """Herfindahl index and largest share of absolute values."""
    g = lines(spark, d).groupBy("l_suppkey", "l_returnflag").agg(F.sum(F.col("px") * F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1)).alias("v"))
    return wallet.shares(g, ["l_suppkey"], "v")


@query(f"""WITH {LI} SELECT l_suppkey, CAST(coalesce(sum(px) FILTER (l_linestatus = 'O'), 0) AS BIGINT) AS maker, CAST(sum(px) AS BIGINT) AS total, CAST(maker * 1000000 // total AS BIGINT) AS maker_ppm FROM li GROUP BY 1""")
def maker_taker_mix(spark, d):
    t = lines(spark, d).groupBy("l_suppkey").agg(F.coalesce(F.sum(F.when(F.col("l_linestatus") == "O", F.col("px"))), F.lit(0)).alias("maker"), F.sum("px").alias("total"))
    return t.withColumn("maker_ppm", wallet.ratio_ppm(F.col("maker"), F.col("total")))


@query(None)
def performance(spark, d):
    """Time- and money-weighted return, drawdown, recovery, shortfall of each customer from orders as observations."""
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("subject"), days("o_orderdate").alias("time"), F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0).alias("kind"),
        F.col("o_orderkey").alias("ordinal"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") % 1000 * 100).otherwise(cents("o_totalprice")).alias("amount"),
    )
    return wallet.performance(o)


LOG = "WITH {EV}, s AS (SELECT user_id, cents - 5000 AS x FROM ev)"


@query(f"""WITH {EV}, s AS (SELECT user_id, cents - 5000 AS x, lag(cents - 5000) OVER (PARTITION BY user_id ORDER BY us, event_id) AS prev FROM ev),
m AS (SELECT user_id, count(*) AS n, CAST(sum(x) AS BIGINT) AS total, CAST(sum(x) AS BIGINT) // count(*) AS mean FROM s GROUP BY 1),
v AS (SELECT m.user_id, n, total, mean, CAST(sum((x - mean) * (x - mean)) AS BIGINT) AS ss, CAST(coalesce(sum((x - mean) * (prev - mean)), 0) AS HUGEINT) AS cov FROM m JOIN s USING (user_id) GROUP BY ALL),
e AS (SELECT *, CAST(CASE WHEN n = 1 THEN 1000 WHEN ss = 0 THEN n * 1000 ELSE least(n * 1000, greatest(1000, n * 1000 * (1000000 - least(greatest(cov * 1000000 // greatest(ss, 1), 0), 990000)) // (1000000 + least(greatest(cov * 1000000 // greatest(ss, 1), 0), 990000)))) END AS BIGINT) AS ess FROM v)
SELECT user_id, mean, ess, (ess * mean) // (ess + 10000) AS posterior, CAST(floor(sqrt(greatest(1, ss // n))) AS BIGINT) * 1000 // greatest(1, CAST(floor(sqrt(ess)) AS BIGINT)) AS se FROM e""")
def skill_posterior(spark, d):
    """Shrunk mean and standard error of each subject's outcomes by effective sample size."""
    s = stats.lag_moments(events(spark, d).withColumn("x", F.col("cents") - 5000), "user_id", ["us", "event_id"], "x")
    s = s.withColumn("ess", stats.effective_sample_milli("n", "square_dev", "lag_products")).withColumn("ss", F.col("square_dev").cast("bigint"))
    p = wallet.skill_posterior(F.col("n"), F.col("total"), F.col("ss"), F.col("ess"))
    return s.select("user_id", p["mean"].alias("mean"), "ess", p["posterior"].alias("posterior"), p["se"].alias("se"))


@query("""WITH z AS (SELECT p_partkey, p_partkey % 41 - 20 AS z FROM part), y AS (SELECT *, z * 1700 AS y, CAST(abs(z) * 1700 AS HUGEINT) AS a FROM z),
t1 AS (SELECT *, 1000000 * a // 1000 AS t1 FROM y), t2 AS (SELECT *, t1 * a // 2000 AS t2 FROM t1), t3 AS (SELECT *, t2 * a // 3000 AS t3 FROM t2), t4 AS (SELECT *, t3 * a // 4000 AS t4 FROM t3),
t5 AS (SELECT *, t4 * a // 5000 AS t5 FROM t4), t6 AS (SELECT *, t5 * a // 6000 AS t6 FROM t5), t7 AS (SELECT *, t6 * a // 7000 AS t7 FROM t6), t8 AS (SELECT *, t7 * a // 8000 AS t8 FROM t7),
s AS (SELECT *, 1000000 + t1 + t2 + t3 + t4 + t5 + t6 + t7 + t8 AS s FROM t8), e AS (SELECT *, CASE WHEN y >= 20000 THEN 0 WHEN y <= -20000 THEN 4294967295 WHEN y >= 0 THEN 1000000000000 // s ELSE s END AS e FROM s)
SELECT p_partkey, z, CAST(1000000000000 // (e + 1000000) AS BIGINT) AS probability_ppm FROM e""")
def skill_probability(spark, d):
    """Logistic probability of each z from the integer series."""
    from ..functions.fixed import logistic_ppm

    z = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 41 - 20).alias("z"))
    return z.select("p_partkey", "z", logistic_ppm("z").alias("probability_ppm"))


FEATURES = {
    "maker": "if(c_custkey % 13 = 0, null, c_custkey * 7919 % 1000000)", "turnover": "c_custkey * 104729 % 1000000", "hold": "c_custkey * 1000003 % 7200000000",
    "reversion": "c_custkey * 31337 % 1000000", "beta": "c_custkey * 37 % 2001 - 1000", "funding": "c_custkey * 611953 % 1000000", "basis": "c_custkey * 15485863 % 1000000",
    "sync": "c_custkey * 49979687 % 1000000", "lag": "c_custkey * 86028121 % 4000000",
    "liquidation": "if(c_custkey % 5 = 0, null, c_custkey % 17 = 0)", "vault": "c_custkey % 23 = 0",
}


@query("""WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey * 7919 % 1000000 END AS maker, c_custkey * 104729 % 1000000 AS turnover, c_custkey * 1000003 % 7200000000 AS hold,
 c_custkey * 31337 % 1000000 AS reversion, c_custkey * 37 % 2001 - 1000 AS beta, c_custkey * 611953 % 1000000 AS funding, c_custkey * 15485863 % 1000000 AS basis, c_custkey * 49979687 % 1000000 AS sync, c_custkey * 86028121 % 4000000 AS lg,
 c_custkey % 5 <> 0 AND c_custkey % 17 = 0 AS liq, c_custkey % 23 = 0 AS vault FROM customer),
w AS (SELECT c_custkey, unnest(range(13)) AS i, unnest([
 1 + 25 * (abs(beta) >= 800)::INT, 1 + 15 * (abs(beta) >= 800)::INT, 1 + 10 * (reversion >= 700000)::INT, 1 + 30 * (turnover >= 800000)::INT + 20 * (hold <= 5000000)::INT,
 1 + 25 * (turnover <= 150000)::INT + 20 * (hold >= 3600000000)::INT, 1 + 40 * coalesce(maker >= 700000, false)::INT + 25 * (reversion >= 700000)::INT, 1 + 35 * (basis >= 700000)::INT,
 1 + 35 * (funding >= 700000)::INT, 1 + 50 * liq::INT, 1, 1 + 50 * vault::INT, 1 + 40 * (sync >= 700000 AND lg <= 2000000)::INT, CASE WHEN maker IS NULL THEN 80 ELSE 1 END]) AS w FROM f),
s AS (SELECT *, w * 1000000 // sum(w) OVER (PARTITION BY c_custkey) AS f, w * 1000000 % sum(w) OVER (PARTITION BY c_custkey) AS r FROM w),
p AS (SELECT c_custkey, i, CAST(f AS BIGINT) + CASE WHEN row_number() OVER (PARTITION BY c_custkey ORDER BY r DESC, i) <= 1000000 - sum(f) OVER (PARTITION BY c_custkey) THEN 1 ELSE 0 END AS ppm FROM s)
SELECT c_custkey, list(ppm ORDER BY i) AS ppm FROM p GROUP BY 1""")
def style_classify(spark, d):
    """Shares of trading styles by largest remainder."""
    f = table(spark, d, "customer").select("c_custkey", *[F.expr(e).alias(k) for k, e in FEATURES.items()])
    w = f.select("c_custkey", wallet.style_weights(*[F.col(k) for k in FEATURES]).alias("w"))
    return w.select("c_custkey", market.allocate_array(F.col("w")).alias("ppm"))


@query(f"""WITH {LI}, x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, px, disc - 300 AS p10, disc - 100 AS p50, disc + 100 AS p90, qty * 1000 AS bankroll, px + 1 AS depth, tax // 10 AS fee, 40 + l_partkey % 60 AS coef, 500000 AS part, 25 AS threshold FROM li),
y AS (SELECT *, least(bankroll * 1000000 // depth, part) AS size FROM x), z AS (SELECT *, coef * size // 1000000 AS impact, (bankroll * part // 1000000) * 1000000 // depth AS used FROM y)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, px, impact, p50 - fee - impact AS net_bps, greatest(0, 1000000 - least(1000000, used)) AS fill_ppm, depth * least(greatest(threshold * 1000000 // coef, 0), 1000000) // 1000000 AS capacity,
CASE WHEN net_bps <= 0 OR p90 <= 0 THEN 'NotCopyable' WHEN impact >= threshold OR fill_ppm < 250000 THEN 'CapacityLimited' WHEN p10 <= 0 OR p90 - p10 >= greatest(net_bps, 1) * 2 THEN 'LatencySensitive' ELSE 'Actionable' END AS class FROM z""")
def copyability(spark, d):
    """Impact, capacity and class of copying each trade."""
    x = lines(spark, d)
    c = F.col
    got = wallet.copyability(
        c("disc") - 300, c("disc") - 100, c("disc") + 100, c("qty") * 1000, c("px") + 1, trunc_div("tax", F.lit(10)), c("l_partkey") % 60 + 40, F.lit(500_000).cast("bigint"), F.lit(25).cast("bigint")
    )
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "px", *[got[k].alias(k) for k in ("impact", "net_bps", "fill_ppm", "capacity", "class")])


@query(f"""WITH {EV}, r AS (SELECT user_id, list_sort(list(cents - 6000)) AS l FROM ev GROUP BY 1)
SELECT user_id, CAST(list_sum(l[1 : (len(l) + 19) // 20]) AS BIGINT) // ((len(l) + 19) // 20) AS es FROM r WHERE len(l) >= 5""")
def expected_shortfall(spark, d):
    """Mean of the ceil(n / 20) worst outcomes, five at least."""
    x = events(spark, d).select("user_id", (F.col("cents") - 6000).alias("x"))
    n = x.groupBy("user_id").agg(F.expr("(count(1) + 19) div 20").alias("worst"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    ranked = x.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("x"))).join(n, "user_id").where("k <= worst")
    return ranked.groupBy("user_id", "worst").agg(F.sum("x").alias("s")).select("user_id", trunc_div("s", "worst").alias("es"))


@query(f"""WITH {EV}, c AS (SELECT user_id, us, event_id, sum(cents - 6000) OVER (PARTITION BY user_id ORDER BY us, event_id) AS cum FROM ev),
p AS (SELECT user_id, cum, greatest(max(cum) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING), 0) AS peak FROM c)
SELECT user_id, CAST(max(peak - cum) AS BIGINT) AS max_drawdown FROM p GROUP BY 1""")
def max_drawdown(spark, d):
    """Largest fall of the cumulative sum below its running peak."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    c = events(spark, d).withColumn("cum", F.sum(F.col("cents") - 6000).over(w))
    p = c.withColumn("peak", F.greatest(F.max("cum").over(w), F.lit(0)))
    return p.groupBy("user_id").agg(F.max(F.col("peak") - F.col("cum")).alias("max_drawdown"))


@query("""WITH n AS (SELECT o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS x, o_orderkey * 7919 % 1000 AS p, o_orderkey AS i FROM orders)
SELECT a.o_custkey, CAST(sum(sign(a.p - b.p) * sign(a.x - b.x)) AS BIGINT) AS score, count(*) AS pairs, CAST(CAST(sum(sign(a.p - b.p) * sign(a.x - b.x)) AS BIGINT) * 100000000 // count(*) AS BIGINT) AS tau_e8
FROM n a JOIN n b ON a.o_custkey = b.o_custkey AND b.i < a.i GROUP BY 1""")
def kendall_tau(spark, d):
    """Kendall's tau of predictions and outcomes of each key, pairs counted by merging."""
    n = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("i"), F.expr("o_orderkey * 7919 % 1000").alias("p"), cents("o_totalprice").alias("x"))
    a = stats.kendall_scores(n, "o_custkey", "p", "x")
    return a.select("o_custkey", "score", "pairs", trunc_div(F.col("score") * 100_000_000, "pairs").alias("tau_e8"))


@query("""WITH r AS (SELECT o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey * 7919 % 10007 DESC, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, ppm, CAST(sum(x) AS BIGINT) // count(*) AS expectancy FROM r, (SELECT unnest([1000000, 500000, 250000]) AS ppm) WHERE k <= greatest(1, n * ppm // 1000000) GROUP BY ALL""")
def capacity_topk(spark, d):
    """Mean outcome of the best 100, 50 and 25 percent by prediction."""
    w = Window.partitionBy("o_custkey")
    r = table(spark, d, "orders").withColumn("x", cents("o_totalprice")).withColumn("k", F.row_number().over(w.orderBy(F.expr("o_orderkey * 7919 % 10007").desc(), "o_orderkey")))
    r = r.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("ppm", F.explode(F.array(F.lit(PPM), F.lit(500_000), F.lit(250_000))))
    r = r.where(F.col("k") <= F.greatest(F.lit(1), trunc_div(F.col("n") * F.col("ppm"), F.lit(PPM))))
    return r.groupBy("o_custkey", "ppm").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("c")).select("o_custkey", "ppm", trunc_div("s", "c").alias("expectancy"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey * 7919 % 1000001 AS p, CASE WHEN o_orderstatus = 'F' THEN 1000000 ELSE 0 END AS y FROM orders)
SELECT o_custkey, CAST(sum((p - y) * (p - y) // 1000000) AS BIGINT) // count(*) AS brier_ppm FROM s GROUP BY 1""")
def brier_score(spark, d):
    s = table(spark, d, "orders").withColumn("e", F.expr("o_orderkey * 7919 % 1000001 - if(o_orderstatus = 'F', 1000000, 0)"))
    t = s.groupBy("o_custkey").agg(F.sum(trunc_div(F.col("e") * F.col("e"), F.lit(PPM))).alias("s"), F.count(F.lit(1)).alias("n"))
    return t.select("o_custkey", trunc_div("s", "n").alias("brier_ppm"))
