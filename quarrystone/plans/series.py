"""Rolling windows, ordered folds, order statistics over event series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.fixed import freshness_ppm, half_even_div, trunc_div
from ..operators import rolling
from .registry import EV, LI, days, events, lines, query, table

HALF_EVEN = """CAST(CASE WHEN 2 * abs({a} % {b}) > {b} OR (2 * abs({a} % {b}) = {b} AND ({a} // {b}) % 2 <> 0) THEN {a} // {b} + CASE WHEN {a} < 0 THEN -1 ELSE 1 END ELSE {a} // {b} END AS BIGINT)"""


@query(f"""WITH {EV}, s AS (SELECT event_id, CAST(sum(cents) OVER w AS HUGEINT) AS a, count(*) OVER w AS b FROM ev
WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT event_id, {HALF_EVEN.format(a='a', b='b')} AS mean FROM s""")
def rolling_event_mean(spark, d):
    return events(spark, d).select("event_id", rolling.count_mean(["user_id"], ["us", "event_id"], "cents", 10).alias("mean"))


@query(f"""WITH {EV}, s AS (SELECT event_id, CAST(sum(cents) OVER w AS HUGEINT) AS a, count(*) OVER w AS b FROM ev
WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW))
SELECT event_id, {HALF_EVEN.format(a='a', b='b')} AS mean FROM s""")
def rolling_time_mean(spark, d):
    return events(spark, d).select("event_id", rolling.time_mean(["user_id"], "us", "cents", 86_400_000_000).alias("mean"))


@query(f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, cents, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM ev),
p AS (SELECT user_id, n, CAST(cents AS HUGEINT) AS v FROM o WHERE n = 1 UNION ALL
  SELECT o.user_id, o.n, CAST({HALF_EVEN.format(a='(o.cents * 250000)', b='1000000')} + {HALF_EVEN.format(a='(p.v * 750000)', b='1000000')} AS HUGEINT) FROM p JOIN o ON o.user_id = p.user_id AND o.n = p.n + 1)
SELECT user_id, CAST(v AS BIGINT) AS ewma FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""")
def ewma(spark, d):
    series = rolling.ordered(events(spark, d), ["user_id"], ["us", "event_id"], ["cents"])
    return series.select("user_id", rolling.ewma(F.col("series"), "cents", 250_000).alias("ewma"))


@query(f"""WITH {EV}, s AS (SELECT user_id, event_type, list_sort(list(cents)) AS l FROM ev GROUP BY ALL)
SELECT user_id, event_type, l[1 + (len(l) - 1) * 900000 // 1000000] AS q90, l[1 + (len(l) - 1) * 10 // 100] AS p10, l[1 + (len(l) - 1) * 50 // 100] AS p50, l[1 + (len(l) - 1) * 99 // 100] AS p99 FROM s""")
def exact_quantiles(spark, d):
    """Exact quantiles by rank: floor((n - 1) q)."""
    place = lambda num, den: F.expr(f"(n - 1) * {num} div {den}")
    picks = {"q90": place(900_000, 1_000_000), "p10": place(10, 100), "p50": place(50, 100), "p99": place(99, 100)}
    return stats.order_statistics(events(spark, d), ["user_id", "event_type"], "cents", picks).drop("n")


@query(f"""WITH {LI}, s AS (SELECT l_suppkey, count(*) AS n, CAST(sum(qty * px) AS HUGEINT) AS xy, CAST(sum(qty) AS HUGEINT) AS x, CAST(sum(px) AS HUGEINT) AS y FROM li GROUP BY 1),
m AS (SELECT l_suppkey, n, {HALF_EVEN.format(a='xy', b='n')} AS exy, {HALF_EVEN.format(a='x', b='n')} AS ex, {HALF_EVEN.format(a='y', b='n')} AS ey FROM s)
SELECT l_suppkey, n, exy - ex * ey AS covariance FROM m WHERE n >= 2""")
def covariance_exact(spark, d):
    big = lambda c: F.sum(F.expr(c).cast("decimal(38,0)"))
    s = lines(spark, d).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), big("qty * px").alias("xy"), big("qty").alias("x"), big("px").alias("y")).where("n >= 2")
    e = {k: half_even_div(k, "n").cast("bigint") for k in ("xy", "x", "y")}
    return s.select("l_suppkey", "n", (e["xy"] - e["x"] * e["y"]).alias("covariance"))


MEDIANS = "l[(len(l) - 1) // 2 + 1] AS lower, l[len(l) // 2 + 1] AS upper, (l[(len(l) - 1) // 2 + 1] + l[len(l) // 2 + 1]) // 2 AS med"


@query(f"""WITH {EV}, s AS (SELECT event_id, list_sort(list(cents) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) AS l FROM ev),
m AS (SELECT event_id, l[(len(l) - 1) // 2 + 1] + l[len(l) // 2 + 1] AS two FROM s)
SELECT event_id, CAST({HALF_EVEN.format(a='two', b='2')} AS BIGINT) AS median FROM m""")
def rolling_event_median(spark, d):
    """Median of the last six values, ties to even."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(-5, 0)
    s = events(spark, d).select("event_id", F.array_sort(F.collect_list("cents").over(w)).alias("l"))
    return s.select("event_id", stats.even_median("l").alias("median"))


@query(f"""WITH {LI}, s AS (SELECT l_suppkey, list_sort(list(px)) AS l FROM li GROUP BY 1), m AS (SELECT l_suppkey, l, {MEDIANS} FROM s),
a AS (SELECT *, list_sort(list_transform(l, lambda x: abs(x - med))) AS dv FROM m),
b AS (SELECT *, (dv[(len(dv) - 1) // 2 + 1] + dv[len(dv) // 2 + 1]) // 2 AS mad FROM a)
SELECT l_suppkey, lower, upper, med AS median, mad, CAST((CAST(l[len(l)] AS HUGEINT) - med) * 674500 // mad AS BIGINT) AS z_max FROM b WHERE len(l) >= 3 AND mad <> 0""")
def robust_z(spark, d):
    """Three medians, MAD and the robust z of the largest value, at least three values and a non-zero MAD."""
    li = lines(spark, d).select("l_suppkey", "px")
    middle = {"lower": F.expr("(n - 1) div 2"), "upper": F.expr("n div 2")}
    m = stats.order_statistics(li, ["l_suppkey"], "px", middle | {"top": F.expr("n - 1")}, least=3)
    m = m.select("l_suppkey", "lower", "upper", "top", trunc_div(F.col("lower") + F.col("upper"), F.lit(2)).alias("median"))
    away = li.join(m.select("l_suppkey", "median"), "l_suppkey").select("l_suppkey", F.abs(F.col("px") - F.col("median")).alias("away"))
    spread = stats.order_statistics(away, ["l_suppkey"], "away", {"a": F.expr("(n - 1) div 2"), "b": F.expr("n div 2")})
    spread = spread.select("l_suppkey", trunc_div(F.col("a") + F.col("b"), F.lit(2)).alias("mad")).where("mad <> 0")
    return m.join(spread, "l_suppkey").select("l_suppkey", "lower", "upper", "median", "mad", stats.robust_z("top", "median", "mad").alias("z_max"))


@query(f"""WITH {EV}, o AS (SELECT user_id, cents, lag(cents) OVER (PARTITION BY user_id ORDER BY us, event_id) AS prev FROM ev),
m AS (SELECT user_id, count(*) AS n, CAST(sum(cents) AS BIGINT) // count(*) AS mean FROM ev GROUP BY 1),
v AS (SELECT m.user_id, n, CAST(sum((cents - mean) * (cents - mean)) AS HUGEINT) AS var, CAST(coalesce(sum((cents - mean) * (prev - mean)), 0) AS HUGEINT) AS cov FROM m JOIN o USING (user_id) GROUP BY ALL),
r AS (SELECT *, CASE WHEN var > 0 THEN least(greatest(cov * 1000000 // var, 0), 990000) END AS rho FROM v)
SELECT user_id, CAST(CASE WHEN n = 1 THEN 1000 WHEN var = 0 THEN n * 1000 ELSE least(n * 1000, greatest(1000, n * 1000 * (1000000 - rho) // (1000000 + rho))) END AS BIGINT) AS ess_milli FROM r""")
def ess_lag1(spark, d):
    """Effective sample size by lag-1 correlation, from sums."""
    s = stats.lag_moments(events(spark, d), "user_id", ["us", "event_id"], "cents")
    return s.select("user_id", stats.effective_sample_milli("n", "square_dev", "lag_products").alias("ess_milli"))


@query(f"""WITH {EV}, h AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS hold FROM ev),
s AS (SELECT user_id, list_sort(list(hold)) AS l, sum(hold) AS total FROM h WHERE hold IS NOT NULL GROUP BY 1)
SELECT user_id, l[1] AS shortest, l[len(l)] AS longest, l[(len(l) - 1) // 2 + 1] AS median, CAST(total AS BIGINT) AS total FROM s""")
def holding_time(spark, d):
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    h = events(spark, d).withColumn("hold", F.col("us") - F.lag("us").over(w)).where("hold is not null")
    total = h.groupBy("user_id").agg(F.min("hold").alias("shortest"), F.max("hold").alias("longest"), F.sum("hold").alias("total"))
    middle = stats.order_statistics(h, ["user_id"], "hold", {"median": F.expr("(n - 1) div 2")}).drop("n")
    return total.join(middle, "user_id").select("user_id", "shortest", "longest", "median", "total")


@query("""WITH k AS (SELECT DISTINCT o_orderkey AS h FROM orders WHERE o_orderstatus <> 'P')
SELECT min(h) // 1000 AS part, min(h) AS first, max(h) AS last, count(*) AS rows FROM (SELECT h, h // 1000 AS part, h - row_number() OVER (PARTITION BY h // 1000 ORDER BY h) AS g FROM k) GROUP BY part, g""")
def gaps_and_islands(spark, d):
    """Runs of consecutive heights within each partition of 1000: what a contiguous drain would emit."""
    k = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.expr("o_orderkey div 1000").alias("part"), F.col("o_orderkey").alias("h"))
    return rolling.islands(k, "h", ["part"])


@query("""WITH k AS (SELECT DISTINCT o_orderkey AS h, o_orderkey // 1000 AS part FROM orders WHERE o_orderstatus <> 'P')
SELECT part, h + 1 AS gap_from, n - 1 AS gap_to FROM (SELECT part, h, lead(h) OVER (PARTITION BY part ORDER BY h) AS n FROM k) WHERE n - h > 1""")
def gap_requests(spark, d):
    k = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.expr("o_orderkey div 1000").alias("part"), F.col("o_orderkey").alias("h"))
    return rolling.gaps(k, "h", ["part"])


@query(f"""WITH {EV}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS revision, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS since FROM ev)
SELECT event_id, revision, since IS NOT NULL AND since <= 0 AS regressed FROM s""")
def revision_numbers(spark, d):
    """Revision of each key's row and whether its time went back."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    since = F.col("us") - F.lag("us").over(w)
    return events(spark, d).select("event_id", F.row_number().over(w).cast("bigint").alias("revision"), F.coalesce(since <= 0, F.lit(False)).alias("regressed"))


@query(f"""WITH {EV}, f AS (SELECT event_id, 1707000000000000 - us AS age FROM ev WHERE us <= 1707000000000000),
k AS (SELECT event_id, age, age // 86400000000 AS k FROM f), v AS (SELECT *, 1000000 >> least(k, 20)::INT AS v FROM k)
SELECT event_id, CASE WHEN k >= 20 THEN 0 ELSE v - CAST(CAST(v AS HUGEINT) * (age % 86400000000) // 172800000000 AS BIGINT) END AS freshness FROM v""")
def freshness_decay(spark, d):
    ev = events(spark, d).where("us <= 1707000000000000")
    return ev.select("event_id", freshness_ppm(F.lit(1707000000000000) - F.col("us"), F.lit(86_400_000_000)).alias("freshness"))


@query(f"""WITH {EV} SELECT us // 3600000000 AS hour, event_type, count(*) AS n FROM ev GROUP BY ALL""")
def throughput_windows(spark, d):
    """Tumbling one-hour throughput."""
    return events(spark, d).groupBy(F.expr("us div 3600000000").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EV}, s AS (SELECT *, CASE WHEN us - lag(us) OVER w > 21600000000 OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
t AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM s)
SELECT user_id, CAST(session AS BIGINT) AS session, min(us) AS first, max(us) AS last, count(*) AS n FROM t GROUP BY ALL""")
def sessions(spark, d):
    """Sessions by a gap of six hours."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    s = events(spark, d).withColumn("fresh", F.when(F.coalesce(F.col("us") - F.lag("us").over(w) <= 21_600_000_000, F.lit(False)), 0).otherwise(1))
    s = s.withColumn("session", F.sum("fresh").over(w))
    return s.groupBy("user_id", "session").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {EV}, o AS (SELECT user_id AS key, event_id AS ordinal, cents * 20 AS x, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM ev),
p AS (SELECT key, ordinal, n, CAST(1 AS BIGINT) AS regime, x AS mean, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS run, true AS changed FROM o WHERE n = 1 UNION ALL
  SELECT key, ordinal, n, CASE WHEN hit THEN regime + 1 ELSE regime END, CASE WHEN hit THEN x ELSE mean END, CASE WHEN hit THEN 0 ELSE s END, CASE WHEN hit THEN 0 ELSE run END, hit FROM (
    SELECT key, ordinal, n, regime, mean, x, s, run, s >= 600000 AND run >= 5 AS hit FROM (
      SELECT o.key, o.ordinal, o.n, p.regime, p.mean, o.x, p.s + greatest(abs(o.x - p.mean) - 50000, 0) AS s, p.run + 1 AS run FROM p JOIN o ON o.key = p.key AND o.n = p.n + 1)))
SELECT key, ordinal, regime, mean FROM p WHERE changed""")
def change_points(spark, d):
    """CUSUM regimes of each user's value series: a stateful fold, one key at a time."""
    ev = events(spark, d).select(F.col("user_id").alias("key"), F.expr("us").alias("us"), F.col("event_id").alias("ordinal"), (F.col("cents") * 20).alias("x"))
    start, step = rolling.cusum(50_000, 600_000, 5)
    return rolling.fold(ev, ["key"], ["us", "ordinal"], "key long, ordinal long, regime long, mean long", start, step)


@query("""WITH p AS (SELECT p_partkey, p_size * 20 AS x FROM part), g AS (SELECT [ {'x': 100, 'y': 50}, {'x': 300, 'y': 170}, {'x': 700, 'y': -30}, {'x': 900, 'y': 5} ] AS g)
SELECT p_partkey, x, CASE WHEN x <= 100 THEN 50 WHEN x >= 900 THEN 5 WHEN x < 300 THEN 50 + 120 * (x - 100) // 200 WHEN x < 700 THEN 170 + (-200 * (x - 300)) // 400 ELSE -30 + 35 * (x - 700) // 200 END AS y FROM p""")
def interpolation(spark, d):
    """Markout at a latency, linear between horizons."""
    points = F.expr("array(named_struct('x', 100L, 'y', 50L), named_struct('x', 300L, 'y', 170L), named_struct('x', 700L, 'y', -30L), named_struct('x', 900L, 'y', 5L))")
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size").cast("bigint") * 20).alias("x"))
    return p.select("p_partkey", "x", rolling.interpolate(points, F.col("x")).alias("y"))


@query(f"""WITH {EV}, l AS (SELECT event_id, user_id, us, cents FROM ev WHERE event_type = 'click'),
h AS (SELECT l.event_id, l.cents AS p0, l.us, l.user_id FROM l),
b AS (SELECT user_id, us AS bus, max(event_id) AS bid, arg_max(cents, event_id) AS p1 FROM ev GROUP BY user_id, us),
j AS (SELECT h.event_id, h.p0, b.p1 FROM (SELECT *, us + 3600000000 AS t FROM h) h ASOF LEFT JOIN b ON h.user_id = b.user_id AND h.t >= b.bus)
SELECT event_id, p0, p1, CASE WHEN p1 IS NOT NULL AND p0 > 0 THEN CAST((p1 - p0) * 1000000 AS BIGINT) // p0 END AS gross FROM j""")
def markout_horizon(spark, d):
    """Markout at a horizon: the latest price of the key at or before entry + one hour."""
    from ..operators.bitemporal import asof_join

    ev = events(spark, d)
    entries = ev.where("event_type = 'click'").select("event_id", F.col("cents").alias("p0"), "user_id", (F.col("us") + 3_600_000_000).alias("t"))
    prices = ev.select("user_id", F.col("us").alias("bus"), F.col("event_id").alias("bid"), F.col("cents").alias("p1"))
    j = asof_join(entries, prices, ["user_id"], "t", "bus", ["p1"], "bid")
    return j.select("event_id", "p0", "p1", F.when(F.col("p0") > 0, trunc_div((F.col("p1") - F.col("p0")) * 1_000_000, F.col("p0"))).alias("gross"))


@query("""SELECT o_custkey, o_orderkey, coalesce(count(*) OVER (PARTITION BY o_custkey, day // 30 ORDER BY day, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS emitted,
day - lag(day) OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey) AS elapsed FROM (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) // 86400000000 AS day FROM orders)""")
def alert_budget(spark, d):
    """Alerts already emitted in the key's budget window and the time since the last one."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", days("o_orderdate").alias("day"))
    budget = Window.partitionBy("o_custkey", F.expr("day div 30")).orderBy("day", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    since = F.col("day") - F.lag("day").over(Window.partitionBy("o_custkey").orderBy("day", "o_orderkey"))
    return o.select("o_custkey", "o_orderkey", F.count(F.lit(1)).over(budget).alias("emitted"), since.alias("elapsed"))
