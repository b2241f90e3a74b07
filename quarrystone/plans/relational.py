"""Point-in-time filters and joins, set operations, routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bitemporal as bt
from .registry import EV, LI, days, events, lines, query, table

E_AT, K_AT = 1705276800000000, 1705708800000000  # 2024-01-15 and 2024-01-20
KNOWN = "us + (event_id % 7) * 1000000"


@query(f"""WITH {EV} SELECT user_id, event_id, us AS effective_at, {KNOWN} AS known_at, cents FROM ev
WHERE us <= {E_AT} AND {KNOWN} <= {K_AT}
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us DESC, known_at DESC, event_id DESC) = 1""")
def asof_feature_join(spark, d):
    """Latest visible event for each user at fixed effective and known times (the flagship)."""
    ev = events(spark, d).withColumn("effective_at", F.col("us")).withColumn("known_at", F.expr(KNOWN))
    seen = ev.where(bt.visible(F.col("effective_at"), F.col("known_at"), None, E_AT, K_AT))
    return bt.latest(seen, ["user_id"], ["effective_at", "known_at", "event_id"], ["event_id", "effective_at", "known_at", "cents"])


@query(f"""WITH {EV}, c AS (SELECT *, {KNOWN} AS known_at, lead({KNOWN}) OVER (PARTITION BY user_id ORDER BY us, event_id) AS superseded_at FROM ev)
SELECT user_id, event_id, known_at, superseded_at FROM c WHERE us <= {E_AT} AND known_at <= {K_AT} AND (superseded_at IS NULL OR superseded_at > {K_AT})""")
def bitemporal_visible(spark, d):
    """Rows visible at both clocks, superseded versions left out."""
    ev = bt.supersede(events(spark, d).withColumn("known_at", F.expr(KNOWN)), ["user_id"], ["us", "event_id"], "known_at")
    return ev.where(bt.visible(F.col("us"), F.col("known_at"), F.col("superseded_at"), E_AT, K_AT)).select("user_id", "event_id", "known_at", "superseded_at")


@query("""SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) // 86400000000 AS day,
lead(epoch_us(o_orderdate) // 86400000000) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS superseded_at,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS revision FROM orders""")
def supersede_chain(spark, d):
    """Versions of each customer's order: revision number and the time the next one supersedes it."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", days("o_orderdate").alias("day"))
    out = bt.supersede(o, ["o_custkey"], ["day", "o_orderkey"], "day")
    return out.withColumn("revision", F.row_number().over(Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")).cast("bigint"))


@query(f"""WITH {LI}, b AS (SELECT l_orderkey % 50 AS market, day, l_orderkey * 10 + l_linenumber AS ord, px FROM li),
bb AS (SELECT market, day, max(ord) AS ord, arg_max(px, ord) AS px FROM b GROUP BY ALL),
a AS (SELECT o_orderkey, o_orderkey % 50 AS market, epoch_us(o_orderdate) // 86400000000 AS day FROM orders)
SELECT a.o_orderkey, a.day, bb.day AS book_day, bb.px FROM a ASOF LEFT JOIN bb ON a.market = bb.market AND a.day >= bb.day""")
def asof_book_lookup(spark, d):
    """The last book snapshot of the market at or before each arrival.

    Of a day's lines the largest ``ord`` with a price counts; lines of equal ``ord`` go to the first of the stored table,
    by file and row, as ``arg_max`` meets them.
    """
    met = F.struct((-F.expr("l_orderkey * 10 + l_linenumber")).alias("ord"), "_metadata.file_path", "_metadata.row_index")
    priced = lines(spark, d).select((F.col("l_orderkey") % 50).alias("market"), F.col("day").alias("book_day"), "px", F.when(F.expr("px IS NOT NULL AND l_linenumber IS NOT NULL"), met).alias("met"))
    books = priced.groupBy("market", "book_day").agg(F.min_by("px", "met").alias("px"))
    arrivals = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 50).alias("market"), days("o_orderdate").alias("day"))
    return bt.asof_join(arrivals, books, ["market"], "day", "book_day", ["book_day", "px"], "book_day").select("o_orderkey", "day", "book_day", "px")


LAG = 600_000_000


@query(f"""WITH {EV}, m AS (
  SELECT l.event_id, f.event_id AS r_id, f.us - l.us AS lag, f.cents AS r_cents, l.user_id
  FROM ev l JOIN ev f ON f.event_type = 'purchase' AND l.event_type = 'click' AND l.user_id % 10 = f.user_id % 10 AND f.us > l.us AND f.us - l.us <= {LAG}
  QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY f.event_id) = 1)
SELECT event_id, r_id, lag, r_cents FROM m""")
def leader_follower_interval(spark, d):
    """For each leader action the first follower row of its market within the lag."""
    ev = events(spark, d).withColumn("market", F.col("user_id") % 10)
    lead, follow = ev.where("event_type = 'click'"), ev.where("event_type = 'purchase'")
    return bt.interval_first(lead, follow, ["market"], "us", "event_id", "event_id", LAG, ["cents"])


@query(f"""WITH {LI}, e AS (
  SELECT o_custkey AS k, epoch_us(o_orderdate) // 86400000000 AS day, 0 AS kind, o_orderkey AS id, 0 AS sub, CAST(round(o_totalprice * 100) AS BIGINT) AS lim, NULL::BIGINT AS px FROM orders
  UNION ALL SELECT l_suppkey, day, 1, l_orderkey, l_linenumber, NULL, px FROM li),
f AS (SELECT *, last_value(lim IGNORE NULLS) OVER (PARTITION BY k ORDER BY day, kind, id, sub, px ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ref FROM e)
SELECT k, count(*) AS fills, count(ref) AS observed, count(*) - count(ref) AS withheld, CAST(sum(px * (px - ref) // ref) AS BIGINT) AS slip
FROM (SELECT * REPLACE (CASE WHEN ref IS NOT NULL THEN px END AS px) FROM f WHERE kind = 1) GROUP BY k""")
def inforce_limit_slippage(spark, d):
    """Fills against the limit in force before them; fills without one are withheld and counted."""
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("k"), days("o_orderdate").alias("day"), F.lit(0).alias("kind"), F.col("o_orderkey").alias("id"), F.lit(0).alias("sub"),
        F.expr("cast(round(o_totalprice * 100) as bigint)").alias("lim"), F.lit(None).cast("bigint").alias("px"),
    )
    f = lines(spark, d).select(F.col("l_suppkey").alias("k"), "day", F.lit(1).alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("sub"), F.lit(None).cast("bigint").alias("lim"), "px")
    all_ = bt.in_force(o.unionByName(f), ["k"], ["day", "kind", "id", "sub", "px"], F.col("lim"), "ref")
    slip = F.expr("(px * (px - ref)) div ref")
    return all_.where("kind = 1").groupBy("k").agg(
        F.count(F.lit(1)).alias("fills"), F.count("ref").alias("observed"), (F.count(F.lit(1)) - F.count("ref")).alias("withheld"), F.sum(slip).alias("slip")
    )


FOLD = {"training_from": 9200, "training_to": 10200, "validation_from": 10230, "validation_to": 10400, "holdout_from": 10800, "purge": 45, "embargo": 20}


@query("""SELECT o_orderkey, day, CASE WHEN day >= 10800 THEN 'holdout' WHEN day BETWEEN 10230 AND 10400 THEN 'validation' WHEN NOT day BETWEEN 9200 AND 10200 THEN 'outside'
WHEN day BETWEEN 10165 AND 10184 THEN 'embargo' WHEN day BETWEEN 10185 AND 10229 OR (day <= 10400 AND 10230 <= day + o_orderkey % 90) THEN 'purged' ELSE 'train' END AS fold
FROM (SELECT o_orderkey, epoch_us(o_orderdate) // 86400000000 AS day FROM orders)""")
def fold_assignment_purged(spark, d):
    """Walk-forward class of each row, with purge, embargo and label overlap."""
    o = table(spark, d, "orders").select("o_orderkey", days("o_orderdate").alias("day"))
    return o.withColumn("fold", bt.fold_class(F.col("day"), F.expr("day + o_orderkey % 90"), FOLD))


@query("""WITH v AS (SELECT unnest(range(0, 6)) AS i), f AS (SELECT i, 9500 + i * 200 AS validation_from, 9500 + i * 200 + 99 AS validation_to FROM v)
SELECT i AS fold, 9132 AS training_from, coalesce(lag(validation_to) OVER (ORDER BY i), 9499) AS training_to, validation_from, validation_to FROM f""")
def expanding_folds(spark, d):
    """Expanding-window folds: each trains up to the end of the previous validation range."""
    v = spark.range(6).select(F.col("id").alias("fold"), (F.lit(9500) + F.col("id") * 200).alias("validation_from"))
    v = v.withColumn("validation_to", F.col("validation_from") + 99)
    before = F.coalesce(F.lag("validation_to").over(Window.orderBy("fold")), F.lit(9499).cast("bigint"))
    return v.select("fold", F.lit(9132).alias("training_from"), before.alias("training_to"), "validation_from", "validation_to")


@query(f"""WITH {EV}, s AS (SELECT user_id, CAST(us // 3600000000 % 24 AS BIGINT) AS h, event_type FROM ev),
a AS (SELECT DISTINCT user_id, h FROM s WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id, h FROM s WHERE event_type = 'purchase'),
x AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, count(*) FILTER (a.h IS NOT NULL AND b.h IS NOT NULL) AS common, count(*) AS total
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.h = b.h GROUP BY 1)
SELECT user_id, common * 1000000 // total AS overlap_ppm FROM x""")
def market_overlap(spark, d):
    """Jaccard overlap, in ppm, of the markets (hours) two sides act in."""
    ev = events(spark, d).withColumn("h", F.expr("(us div 3600000000) % 24"))
    sets = ev.where("event_type in ('click', 'purchase')").groupBy("user_id").agg(
        F.collect_set(F.when(F.col("event_type") == "click", F.col("h"))).alias("a"), F.collect_set(F.when(F.col("event_type") == "purchase", F.col("h"))).alias("b")
    )
    return sets.select("user_id", F.expr("cast(size(array_intersect(a, b)) as bigint) * 1000000 div size(array_union(a, b))").alias("overlap_ppm"))


TTL = 3_600_000_000


@query(f"""WITH {EV}, p AS (SELECT * FROM ev WHERE event_type = 'click'), c AS (SELECT * FROM ev WHERE event_type = 'view'),
m AS (SELECT p.event_id, p.us, min(c.us) AS c_us, arg_min(c.cents % 3, (c.us, c.event_id)) AS c_hash, any_value(p.cents % 3) AS p_hash
FROM p LEFT JOIN c ON c.user_id = p.user_id AND c.us >= p.us AND c.us - p.us <= {TTL} GROUP BY p.event_id, p.us)
SELECT event_id, CASE WHEN c_us IS NULL THEN 'Expired' WHEN c_hash = p_hash THEN 'Confirmed' ELSE 'Conflict' END AS outcome FROM m""")
def provisional_match(spark, d):
    """Provisional rows against the first committed row of their key inside the time to live."""
    ev = events(spark, d).withColumn("b", F.expr(f"us div {TTL}"))
    p = ev.where("event_type = 'click'").select("event_id", "us", "user_id", (F.col("cents") % 3).alias("p_hash"), F.explode(F.expr("array(b, b + 1)")).alias("b"))
    c = ev.where("event_type = 'view'").select("user_id", F.col("us").alias("c_us"), F.col("event_id").alias("c_id"), (F.col("cents") % 3).alias("c_hash"), "b")
    cond = (p["user_id"] == c["user_id"]) & (p["b"] == c["b"]) & (c["c_us"] >= p["us"]) & (c["c_us"] - p["us"] <= TTL)
    m = p.join(c, cond, "left").groupBy("event_id").agg(F.min_by("c_hash", F.when(F.col("c_us").isNotNull(), F.struct("c_us", "c_id"))).alias("c_hash"), F.first("p_hash").alias("p_hash"))
    return m.select("event_id", F.expr("CASE WHEN c_hash IS NULL THEN 'Expired' WHEN c_hash = p_hash THEN 'Confirmed' ELSE 'Conflict' END").alias("outcome"))


@query(f"""WITH {LI}, a AS (SELECT l_returnflag AS side, px // 100000 AS level, sum(qty) AS qty FROM li WHERE l_partkey % 2 = 0 GROUP BY ALL),
b AS (SELECT l_returnflag AS side, px // 100000 AS level, sum(qty) AS qty FROM li WHERE l_partkey % 2 = 1 GROUP BY ALL)
SELECT coalesce(a.side, b.side) AS side, coalesce(a.level, b.level) AS level, CAST(a.qty AS BIGINT) AS derived, CAST(b.qty AS BIGINT) AS official, a.qty IS NOT DISTINCT FROM b.qty AS agrees
FROM a FULL JOIN b ON a.side = b.side AND a.level = b.level""")
def l2_reconcile(spark, d):
    """Derived against official book levels: full outer by side and level; any difference means quarantine."""
    li = lines(spark, d).withColumn("level", F.expr("px div 100000"))
    half = lambda k, name: li.where(f"l_partkey % 2 = {k}").groupBy(F.col("l_returnflag").alias("side"), "level").agg(F.sum("qty").alias(name))
    out = half(0, "derived").join(half(1, "official"), ["side", "level"], "full_outer")
    return out.withColumn("agrees", F.col("derived").eqNullSafe(F.col("official")))


@query("""SELECT o_orderkey, o_orderstatus, count(*) AS legs FROM (
  SELECT o_orderkey, o_orderstatus, unnest(CASE o_orderstatus WHEN 'F' THEN ['order', 'trade', 'position'] WHEN 'P' THEN ['order', 'trade'] ELSE ['order'] END) AS owner FROM orders)
GROUP BY ALL""")
def owner_routing(spark, d):
    """Event kind to its reducers by a small decision table that is broadcast."""
    rules = spark.sql("SELECT * FROM VALUES ('F','order'),('F','trade'),('F','position'),('P','order'),('P','trade'),('O','order') AS t(o_orderstatus, owner)")
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(F.broadcast(rules), "o_orderstatus").groupBy("o_orderkey", "o_orderstatus").agg(F.count("owner").alias("legs"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def unreachable_rows(spark, d):
    """Present but not reachable: an anti join."""
    p = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(p, "c_custkey", "left_anti")


@query("""SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
def shared_keys(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s)


@query(f"""WITH {LI}, x AS (SELECT l_orderkey AS height, sum(px) AS h FROM li WHERE l_linestatus = 'O' GROUP BY 1 UNION ALL SELECT l_orderkey, sum(px) FROM li WHERE l_returnflag = 'R' GROUP BY 1)
SELECT height, count(*) AS sources, count(DISTINCT h) > 1 AS conflict FROM x GROUP BY height""")
def merge_sources(spark, d):
    """Union of two sources' evidence for each height: equal digests merge, different ones conflict."""
    li = lines(spark, d).withColumn("height", F.col("l_orderkey"))
    part = lambda cond: li.where(cond).groupBy("height").agg(F.sum("px").alias("h"))
    return part("l_linestatus = 'O'").unionByName(part("l_returnflag = 'R'")).groupBy("height").agg(F.count(F.lit(1)).alias("sources"), (F.min("h") != F.max("h")).alias("conflict"))


@query("""SELECT o_custkey, sha256(string_agg(p, '|' ORDER BY p)) AS originators FROM (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders) GROUP BY 1""")
def originator_hash(spark, d):
    """Digest of each key's sorted distinct members."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|"), 256).alias("originators"))


@query("""SELECT n_nationkey, count(DISTINCT c_mktsegment) AS segments, count(DISTINCT c_mktsegment) > 4 AS conflict
FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def identity_conflicts(spark, d):
    """Members linked to more owners than allowed."""
    j = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_nationkey").agg(F.countDistinct("c_mktsegment").alias("segments")).withColumn("conflict", F.col("segments") > 4)


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props_parse(spark, d):
    """Strict parse of the payload by an explicit schema; a malformed row raises."""
    parsed = F.from_json("props", "k bigint", {"mode": "FAILFAST"})
    return table(spark, d, "events").select("event_id", parsed["k"].alias("k"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'quarantine' WHEN 'view' THEN 'reconciliation' ELSE 'ledger' END AS lane,
CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'Missing' WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 90 THEN 'Malformed' ELSE 'Observed' END AS admission FROM events""")
def admission_and_lane(spark, d):
    """Typed admission of an observation and the lane its input goes to."""
    k = F.from_json("props", "k bigint")["k"]
    admission = F.when(k.isNull(), "Missing").when(k > 90, "Malformed").otherwise("Observed")
    lane = F.when(F.col("event_type") == "error", "quarantine").when(F.col("event_type") == "view", "reconciliation").otherwise("ledger")
    return table(spark, d, "events").select("event_id", lane.alias("lane"), admission.alias("admission"))
