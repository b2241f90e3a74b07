"""Exact arithmetic and archive-style aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as fx
from .registry import EV, LI, events, lines, query, table


@query(f"""WITH {LI}, x AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST((px - 3000000) * (CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END) AS HUGEINT) AS a, CAST(qty * 7 AS HUGEINT) AS b FROM li)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(a // b AS BIGINT) AS toward_zero, CAST(a // b - CASE WHEN a % b < 0 THEN 1 ELSE 0 END AS BIGINT) AS floor_, CAST(a // b + CASE WHEN a % b > 0 THEN 1 ELSE 0 END AS BIGINT) AS ceiling_,
CAST(CASE WHEN 2 * abs(a % b) > b OR (2 * abs(a % b) = b AND (a // b) % 2 <> 0) THEN a // b + CASE WHEN a < 0 THEN -1 ELSE 1 END ELSE a // b END AS BIGINT) AS nearest_even FROM x""")
def decimal_rounding(spark, d):
    """The four rounding modes on exact integers."""
    x = lines(spark, d).withColumn("a", (F.col("px") - 3_000_000) * F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1)).withColumn("b", F.col("qty") * 7)
    names = {"toward_zero": "toward_zero", "floor_": "floor", "ceiling_": "ceiling", "nearest_even": "nearest_even"}
    return x.select("l_orderkey", "l_linenumber", "l_partkey", *[fx.ROUNDINGS[m]("a", "b").cast("bigint").alias(k) for k, m in names.items()])


@query(f"""WITH {LI}, g AS (SELECT l_suppkey, CAST(sum(CAST(px AS HUGEINT) * qty) AS HUGEINT) AS notional, sum(qty) AS q FROM li GROUP BY 1)
SELECT l_suppkey, CAST(notional AS DECIMAL(38,0)) AS notional, CAST(notional // q AS BIGINT) AS vwap FROM g""")
def exact_notional(spark, d):
    """Lossless price times quantity, summed."""
    g = lines(spark, d).groupBy("l_suppkey").agg(F.sum((fx.wide("px") * fx.wide("qty")).cast("decimal(38,0)")).alias("notional"), F.sum("qty").alias("q"))
    return g.select("l_suppkey", F.col("notional").cast("decimal(38,0)").alias("notional"), fx.trunc_wide("notional", "q").cast("bigint").alias("vwap"))


@query(f"""WITH {EV} SELECT strftime(make_timestamp(us), '%Y-%m-%d/%H') AS part, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM ev GROUP BY 1""")
def hour_partitions(spark, d):
    """Archive partitions: rows and key range of each hour."""
    return events(spark, d).groupBy(fx.hour_partition("us").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("""SELECT o_orderkey, sha256(strlen(o_custkey::VARCHAR) || ':' || o_custkey::VARCHAR || strlen(o_orderstatus) || ':' || o_orderstatus || strlen(o_orderpriority) || ':' || o_orderpriority) AS event_id FROM orders""")
def event_identity(spark, d):
    """Event ids as digests of length-framed parts."""
    return table(spark, d, "orders").select("o_orderkey", fx.framed_digest("o_custkey", "o_orderstatus", "o_orderpriority").alias("event_id"))


@query(f"""WITH {EV} SELECT event_type AS namespace, count(*) AS rows, count(DISTINCT user_id) AS subjects, min(us) AS first, max(us) AS last FROM ev GROUP BY 1""")
def namespace_counts(spark, d):
    return events(spark, d).groupBy(F.col("event_type").alias("namespace")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("user_id").alias("subjects"), F.min("us").alias("first"), F.max("us").alias("last")
    )


@query("""SELECT p_partkey, CAST(floor(sqrt(x)) AS BIGINT) AS root FROM (SELECT p_partkey, p_partkey * 7919 % 1000003 AS x FROM part)""")
def integer_roots(spark, d):
    return table(spark, d, "part").select("p_partkey", fx.isqrt(F.expr("p_partkey * 7919 % 1000003")).alias("root"))


@query("""SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS raw FROM part""")
def parse_fixed_point(spark, d):
    """Decimal texts to raw integers at scale 2; excess digits raise."""
    text = F.expr("format_string('%.2f', p_retailprice)")
    return table(spark, d, "part").select("p_partkey", fx.parse_at_scale(text, 2).cast("bigint").alias("raw"))


@query(f"""WITH {LI}, w AS (SELECT l_suppkey, (l_partkey % 7 - 3) * 33333333 + 1 AS w, (disc - 500) * 12345679 AS x FROM li)
SELECT l_suppkey, CAST(100000000 + sum(CAST(w AS HUGEINT) * x // 100000000) AS BIGINT) AS score FROM w GROUP BY 1""")
def linear_scores(spark, d):
    """Intercept plus weighted features at scale 8, each product cut toward zero at scale 8."""
    w = lines(spark, d).select("l_suppkey", F.expr("(l_partkey % 7 - 3) * 33333333 + 1").alias("w"), F.expr("(disc - 500) * 12345679").alias("x"))
    return w.groupBy("l_suppkey").agg((F.sum(fx.trunc_wide(fx.wide("w") * fx.wide("x"), F.lit(100_000_000)).cast("bigint")) + 100_000_000).alias("score"))


@query(f"""WITH {LI}, s AS (SELECT l_suppkey, count(*) AS n, sum(qty) AS sx, sum(disc) AS sy FROM li GROUP BY 1), m AS (SELECT l_suppkey, n, CAST(sx AS BIGINT) * 1000 // n AS mx, CAST(sy AS BIGINT) * 1000 // n AS my FROM s),
c AS (SELECT m.l_suppkey, n, mx, my, CAST(sum((qty * 1000 - mx) * (disc * 1000 - my)) AS HUGEINT) AS cov, CAST(sum((qty * 1000 - mx) * (qty * 1000 - mx)) AS HUGEINT) AS var FROM m JOIN li USING (l_suppkey) GROUP BY ALL)
SELECT l_suppkey, CAST(cov * 100000000 // var AS BIGINT) AS slope_e8, my - CAST((cov * 100000000 // var) * mx // 100000000 AS BIGINT) AS intercept FROM c WHERE var <> 0""")
def univariate_fit(spark, d):
    """Least squares of one feature in two passes, every quotient truncated."""
    li = lines(spark, d)
    m = li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("sx"), F.sum("disc").alias("sy"))
    m = m.select("l_suppkey", F.expr("sx * 1000 div n").alias("mx"), F.expr("sy * 1000 div n").alias("my"))
    dev = li.join(m, "l_suppkey").withColumn("dx", F.expr("qty * 1000 - mx")).withColumn("dy", F.expr("disc * 1000 - my"))
    c = dev.groupBy("l_suppkey", "mx", "my").agg(F.sum(fx.wide(F.col("dx") * F.col("dy"))).cast("decimal(38,0)").alias("cov"), F.sum(fx.wide(F.col("dx") * F.col("dx"))).cast("decimal(38,0)").alias("var")).where("var <> 0")
    slope = fx.trunc_wide(F.col("cov") * 100_000_000, "var")
    return c.select("l_suppkey", slope.cast("bigint").alias("slope_e8"), (F.col("my") - fx.trunc_wide(slope * fx.wide("mx"), F.lit(100_000_000)).cast("bigint")).alias("intercept"))
