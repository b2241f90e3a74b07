"""Market intelligence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions.fixed import PPM, scale_ppm, trunc_div, trunc_wide
from ..operators import market
from .registry import EV, LI, cents, events, lines, query, table

KINDS = "CASE event_id % 6 WHEN 0 THEN 'OpenLong' WHEN 1 THEN 'AddLong' WHEN 2 THEN 'ReduceLong' WHEN 3 THEN 'OpenShort' WHEN 4 THEN 'ReduceShort' ELSE 'CloseLong' END"
FACTORS = ["400000 + (event_id * 37) % 600000", "least(greatest(500000 + 5000 * (event_id % 200 - 100), 0), 1000000)", "900000 - (user_id % 50) * 1000", "250000 + (event_id % 8) * 90000"]


def _product() -> str:
    out = FACTORS[0]
    out = f"({out})"
    for f in FACTORS[1:]:
        out = f"(({out} * ({f})) // 1000000)"
    return out


@query(f"""WITH {EV}, s AS (SELECT user_id % 20 AS market, cents, CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN -1 WHEN 3 THEN -1 WHEN 4 THEN 1 ELSE 0 END AS sign, {_product()} AS weight, 250000 + (event_id % 8) * 90000 AS independence FROM ev),
t AS (SELECT market, CAST(sum(sign * cents * weight // 1000000) AS BIGINT) AS raw, CAST(sum(independence) AS BIGINT) AS votes, CAST(sum(cents) AS HUGEINT) AS vol, count(*) AS n FROM s GROUP BY 1),
u AS (SELECT *, CAST((greatest(vol, 1000) * 400000 + greatest(n, 1000) * 300000 + greatest(vol // 2, 500) * 300000) // 1000000 AS BIGINT) AS denom FROM t)
SELECT market, raw, votes, denom, CAST(CAST(raw AS HUGEINT) * 1000000 // denom AS BIGINT) AS normalised FROM u""")
def smart_flow(spark, d):
    """Signed new risk by eight-factor weights, votes, and the flow over the liquidity denominator."""
    ev = events(spark, d).withColumn("kind", F.expr(KINDS)).withColumn("market", F.col("user_id") % 20)
    weights = [F.expr(f).cast("bigint") for f in FACTORS]
    flow = market.weighted_flow(market.risk_sign(F.col("kind")), F.col("cents"), *weights)
    t = ev.select("market", "cents", flow.alias("flow"), weights[3].alias("independence")).groupBy("market").agg(
        F.sum("flow").alias("raw"), F.sum("independence").alias("votes"), F.sum("cents").alias("vol"), F.count(F.lit(1)).alias("n")
    )
    denom = market.liquidity_denominator([(F.col("vol"), 1000, 400_000), (F.col("n"), 1000, 300_000), (F.expr("vol div 2"), 500, 300_000)])
    return t.select("market", "raw", "votes", denom.alias("denom"), trunc_wide(F.col("raw").cast("decimal(38,0)") * PPM, denom).cast("bigint").alias("normalised"))


@query(f"""WITH {EV}, s AS (SELECT user_id % 20 AS market, event_type AS leg, cents * (400000 + (event_id * 37) % 600000) // 1000000 AS w FROM ev)
SELECT market, CAST(coalesce(sum(w) FILTER (leg IN ('click', 'view')), 0) AS BIGINT) AS open_long, CAST(coalesce(sum(w) FILTER (leg = 'error'), 0) AS BIGINT) AS close_short,
CAST(coalesce(sum(w) FILTER (leg = 'purchase'), 0) AS BIGINT) AS open_short, CAST(coalesce(sum(w) FILTER (leg = 'signup'), 0) AS BIGINT) AS close_long, open_long - open_short AS informed FROM s GROUP BY 1""")
def taker_aggression(spark, d):
    """Weighted taker notional by leg in one pass."""
    ev = events(spark, d).withColumn("w", scale_ppm("cents", F.expr("400000 + (event_id * 37) % 600000")))
    leg = lambda cond, name: F.coalesce(F.sum(F.when(F.expr(cond), F.col("w"))), F.lit(0)).alias(name)
    t = ev.groupBy((F.col("user_id") % 20).alias("market")).agg(
        leg("event_type in ('click', 'view')", "open_long"), leg("event_type = 'error'", "close_short"), leg("event_type = 'purchase'", "open_short"), leg("event_type = 'signup'", "close_long")
    )
    return t.withColumn("informed", F.col("open_long") - F.col("open_short"))


@query("""WITH m AS (SELECT c_custkey, c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT) AS bal, c_mktsegment, c_custkey % 100 AS skill FROM customer),
x AS (SELECT *, (skill >= 30 AND c_mktsegment = 'BUILDING') OR NOT bal >= 100000 AS num, skill >= 10 AS den FROM m)
SELECT c_nationkey, count(*) FILTER (num) AS members, CAST(coalesce(sum(bal) FILTER (num), 0) AS BIGINT) AS numerator, CAST(sum(bal) FILTER (den) AS BIGINT) AS denominator,
CASE WHEN denominator <> 0 THEN CAST(CAST(numerator AS HUGEINT) * 100000000 // denominator AS BIGINT) END AS ratio_e8 FROM x GROUP BY 1""")
def cohort_ratio(spark, d):
    """Two cohorts by ordered predicates; their measure and its ratio at scale 8."""
    m = table(spark, d, "customer").select("c_nationkey", cents("c_acctbal").alias("bal"), "c_mktsegment", (F.col("c_custkey") % 100).alias("skill"))
    num = market.matches(market.Or((market.And((market.AtLeast("skill", 30), market.Equals("c_mktsegment", "BUILDING"))), market.Not(market.AtLeast("bal", 100_000)))))
    den = market.matches(market.AtLeast("skill", 10))
    t = m.withColumn("num", num).withColumn("den", den).groupBy("c_nationkey").agg(
        F.count(F.when(F.col("num"), 1)).alias("members"), F.coalesce(F.sum(F.when(F.col("num"), F.col("bal"))), F.lit(0)).alias("numerator"), F.sum(F.when(F.col("den"), F.col("bal"))).alias("denominator")
    )
    ratio = F.when(F.col("denominator") != 0, trunc_wide(F.col("numerator").cast("decimal(38,0)") * 100_000_000, "denominator").cast("bigint"))
    return t.withColumn("ratio_e8", ratio)


@query(f"""WITH {LI}, x AS (SELECT l_partkey % 200 AS market, px, 900000 - tax * 100 AS w, l_linenumber % 3 = 0 AS follows, l_returnflag = 'R' AS post, tax * 1250 AS fund, qty * 400 AS lev, CAST(floor((disc - 500) / 25.0) AS BIGINT) AS bin FROM li),
t AS (SELECT market, sum(px) AS total FROM x GROUP BY 1),
h AS (SELECT x.market, least(1000000, CAST(sum((px * 1000 // total) * (px * 1000 // total)) AS BIGINT)) AS hhi FROM x JOIN t USING (market) GROUP BY 1)
SELECT x.market, CAST(sum(w) AS BIGINT) AS independent, any_value(hhi) AS hhi, CAST(coalesce(sum(w) FILTER (follows), 0) * 1000000 // sum(w) AS BIGINT) AS follower_saturation,
CAST(coalesce(sum(px) FILTER (post), 0) * 1000000 // sum(px) AS BIGINT) AS post_share, 1000000 // count(DISTINCT bin) AS clustering, CAST(sum(fund) AS BIGINT) // count(*) AS funding,
least(CAST(sum(lev) AS BIGINT) // count(*), 1000000) AS leverage, CAST(sum(px) * 1000000 // (sum(px) + 500000000) AS BIGINT) AS consumed FROM x JOIN h USING (market) GROUP BY x.market""")
def crowding_components(spark, d):
    """The eight crowding components of each market: independence, concentration, followers, follow-on share, entry
    clustering, funding percentile, leverage, capacity used."""
    x = lines(spark, d).selectExpr(
        "l_partkey % 200 AS market", "px", "disc", "900000 - tax * 100 AS w", "l_linenumber % 3 = 0 AS follows", "l_returnflag = 'R' AS post", "tax * 1250 AS fund", "qty * 400 AS lev",
    ).withColumn("bin", market.euclid_bin(F.col("disc") - 500, 25))
    where = lambda cond, c: F.coalesce(F.sum(F.when(F.col(cond), F.col(c))), F.lit(0))
    t = x.groupBy("market").agg(
        F.sum("w").alias("independent"), where("follows", "w").alias("follower"), F.sum("px").alias("total"), where("post", "px").alias("post"),
        F.countDistinct("bin").alias("bins"), F.sum("fund").alias("fund"), F.sum("lev").alias("lev"), F.count(F.lit(1)).alias("n"),
    )
    h = market.hhi(x, ["market"], "px", 1000, PPM)
    share = lambda a, b: F.when(b != 0, trunc_wide(F.col(a).cast("decimal(38,0)") * PPM, b)).otherwise(0).cast("bigint")
    return t.join(h, "market").select(
        "market", "independent", "hhi", share("follower", F.col("independent")).alias("follower_saturation"), share("post", F.col("total")).alias("post_share"),
        trunc_div(F.lit(PPM), "bins").alias("clustering"), trunc_div("fund", "n").alias("funding"), F.least(trunc_div("lev", "n"), F.lit(PPM)).alias("leverage"),
        share("total", F.col("total") + 500_000_000).alias("consumed"),
    )


@query(f"""WITH {LI} SELECT l_suppkey, CAST(floor((disc - 500) / 25.0) AS BIGINT) AS bin, CAST(sum(px) AS BIGINT) AS mass, count(*) AS n FROM li GROUP BY ALL""")
def entry_histogram(spark, d):
    """Entries by Euclidean 25-bps bin."""
    x = lines(spark, d).withColumn("bin", market.euclid_bin(F.col("disc") - 500, 25))
    return x.groupBy("l_suppkey", "bin").agg(F.sum("px").alias("mass"), F.count(F.lit(1)).alias("n"))


@query("""WITH w AS (SELECT o_custkey, o_orderpriority AS leg, CAST(round(sum(CAST(round(o_totalprice * 100) AS BIGINT))) AS HUGEINT) AS w FROM orders GROUP BY ALL),
f AS (SELECT *, w * 1000000 // sum(w) OVER (PARTITION BY o_custkey) AS f, w * 1000000 % sum(w) OVER (PARTITION BY o_custkey) AS r FROM w)
SELECT o_custkey, leg, CAST(f AS BIGINT) + CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY r DESC, leg) <= 1000000 - sum(f) OVER (PARTITION BY o_custkey) THEN 1 ELSE 0 END AS ppm FROM f""")
def ppm_allocation(spark, d):
    """Largest-remainder shares of exactly 1,000,000."""
    w = table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("leg")).agg(F.sum(cents("o_totalprice")).alias("w"))
    return market.allocate_ppm(w, ["o_custkey"], "w", "leg").select("o_custkey", "leg", "ppm")


STATE = "c_custkey * 37 % 2500 AS vol, c_custkey * 91 % 1200 - 600 AS trend, c_custkey * 53 % 1600 AS oi, c_custkey * 7919 % 1000000 AS liquidity, c_custkey * 104729 % 1000000 AS corr"


@query(f"""WITH s AS (SELECT c_custkey, {STATE} FROM customer), w AS (SELECT c_custkey, unnest([
 CASE WHEN vol <= 400 AND abs(trend) < 250 THEN 40 ELSE 1 END, CASE WHEN vol >= 1800 AND abs(trend) < 400 AND liquidity < 400000 THEN 35 ELSE 1 END,
 CASE WHEN trend > 250 AND oi < 800 THEN 30 ELSE 1 END, CASE WHEN trend < -250 AND oi < 800 THEN 30 ELSE 1 END, CASE WHEN trend > 250 AND oi >= 800 THEN 35 ELSE 1 END,
 CASE WHEN trend < -250 AND oi >= 800 THEN 35 ELSE 1 END, CASE WHEN liquidity < 250000 OR corr > 700000 THEN 45 ELSE 1 END, CASE WHEN liquidity >= 500000 THEN 40 ELSE 1 END]) AS w, unnest(range(8)) AS i FROM s),
f AS (SELECT *, w * 1000000 // sum(w) OVER (PARTITION BY c_custkey) AS f, w * 1000000 % sum(w) OVER (PARTITION BY c_custkey) AS r FROM w),
p AS (SELECT c_custkey, i, CAST(f AS BIGINT) + CASE WHEN row_number() OVER (PARTITION BY c_custkey ORDER BY r DESC, i) <= 1000000 - sum(f) OVER (PARTITION BY c_custkey) THEN 1 ELSE 0 END AS ppm FROM f),
q AS (SELECT c_custkey, list(ppm ORDER BY i) AS ppm FROM p GROUP BY 1)
SELECT c_custkey, ppm, list_max(ppm) AS top, ['QuietRange','VolatileRange','OrderlyUp','OrderlyDown','LeveragedUp','LeveragedDown','LiquidityStress','PostLiquidation'][list_position(ppm, list_max(ppm))] AS dominant,
CAST(1000000 - (list_max(ppm) - list_sort(ppm, 'DESC')[2]) AS BIGINT) AS change FROM q""")
def regime_classify(spark, d):
    """Shares of eight regimes from integer weights, the dominant one, and how close the second is."""
    s = table(spark, d, "customer").selectExpr("c_custkey", *STATE.split(", "))
    c = F.col
    w = market.regime_weights(c("vol"), c("trend"), c("oi"), c("liquidity"), c("corr"))
    p = s.select("c_custkey", w.alias("w")).select("c_custkey", market.allocate_array(F.col("w")).alias("ppm")).withColumn("top", F.array_max("ppm"))
    second = F.get(F.sort_array("ppm", asc=False), F.lit(1))
    names = F.array(*map(F.lit, market.REGIMES))
    return p.select("c_custkey", "ppm", "top", F.get(names, (F.array_position("ppm", F.col("top")) - 1).cast("int")).alias("dominant"), (F.lit(PPM) - (F.col("top") - second)).alias("change"))


def _shares_sql(w: str) -> str:
    """DuckDB: a list of eight weights to largest-remainder shares of 1,000,000."""
    t, rest = f"CAST(list_sum({w}) AS BIGINT)", lambda i: f"({w}[{i}] * 1000000 % CAST(list_sum({w}) AS BIGINT))"
    ahead = f"list_sum(list_transform([1, 2, 3, 4, 5, 6, 7, 8], lambda j: CASE WHEN {rest('j')} > {rest('i')} OR ({rest('j')} = {rest('i')} AND j < i) THEN 1 ELSE 0 END))"
    left = f"1000000 - list_sum(list_transform({w}, lambda x: x * 1000000 // {t}))"
    return f"list_transform([1, 2, 3, 4, 5, 6, 7, 8], lambda i: CAST({w}[i] * 1000000 // {t} + CASE WHEN {ahead} < {left} THEN 1 ELSE 0 END AS BIGINT))"


@query(f"""WITH RECURSIVE {EV}, s AS (SELECT user_id AS key, us // 3600000000 * 100000000 AS known, event_id AS ordinal, event_type <> 'error' AS ok, cents * 37 % 2500 AS vol, cents * 91 % 1200 - 600 AS trend, cents * 53 % 1600 AS oi, cents * 7919 % 1000000 AS liquidity, cents * 104729 % 1000000 AS corr FROM ev),
w AS (SELECT key, known, ordinal, ok, CASE WHEN ok THEN [CASE WHEN vol <= 400 AND abs(trend) < 250 THEN 40 ELSE 1 END, CASE WHEN vol >= 1800 AND abs(trend) < 400 AND liquidity < 400000 THEN 35 ELSE 1 END,
 CASE WHEN trend > 250 AND oi < 800 THEN 30 ELSE 1 END, CASE WHEN trend < -250 AND oi < 800 THEN 30 ELSE 1 END, CASE WHEN trend > 250 AND oi >= 800 THEN 35 ELSE 1 END, CASE WHEN trend < -250 AND oi >= 800 THEN 35 ELSE 1 END,
 CASE WHEN liquidity < 250000 OR corr > 700000 THEN 45 ELSE 1 END, CASE WHEN liquidity >= 500000 THEN 40 ELSE 1 END]::BIGINT[] ELSE [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[] END AS w FROM s),
o AS (SELECT key, known, ordinal, ok, {_shares_sql('w')} AS own, row_number() OVER (PARTITION BY key ORDER BY known, ordinal) AS n FROM w),
p AS (SELECT key, known, ordinal, ok, n, own AS ppm FROM o WHERE n = 1 UNION ALL
 SELECT key, known, ordinal, ok, n, CASE WHEN boosted THEN {_shares_sql('up')} ELSE own END FROM (
  SELECT o.key, o.known, o.ordinal, o.ok, o.n, o.own, o.ok AND o.known - p.known < 300000000 AS boosted,
   list_transform(o.own, lambda x, i: CASE WHEN i = list_position(p.ppm, list_max(p.ppm)) THEN x + p.ppm[i] + 200000 ELSE x END) AS up FROM p JOIN o ON o.key = p.key AND o.n = p.n + 1))
SELECT key, ordinal, ppm, CASE WHEN ok THEN ['QuietRange','VolatileRange','OrderlyUp','OrderlyDown','LeveragedUp','LeveragedDown','LiquidityStress','PostLiquidation'][list_position(ppm, list_max(ppm))] ELSE 'Unsupported' END AS dominant,
CAST(CASE WHEN ok THEN 1000000 - (list_max(ppm) - list_sort(ppm, 'DESC')[2]) ELSE 1000000 END AS BIGINT) AS change FROM p""")
def regime_path(spark, d):
    """Regimes of each user over its events, with the dwell boost of the state before."""
    c, x = F.col, F.col("cents")
    w = market.regime_weights(x * 37 % 2500, x * 91 % 1200 - 600, x * 53 % 1600, x * 7919 % 1000000, x * 104729 % 1000000)
    known = F.expr("us div 3600000000 * 100000000")
    ev = events(spark, d).select(c("user_id").alias("key"), known.alias("known"), c("event_id").alias("ordinal"), F.when(c("event_type") != "error", w).otherwise(F.array().cast("array<bigint>")).alias("weights"))
    return market.regime_path(ev)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'Unknown' WHEN c_custkey % 300 <= 40 THEN 'NearLiquidation' WHEN abs(c_custkey * 7 % 401 - 200) <= 15 THEN 'NearBreakEven'
WHEN c_custkey * 7 % 401 - 200 < 0 AND c_custkey * 131 % 7200 * 1000000 >= 3600000000 THEN 'VoluntaryExit' WHEN c_custkey * 7 % 401 - 200 < 0 THEN 'Underwater' ELSE 'Profitable' END AS state FROM customer""")
def pain_states(spark, d):
    k = F.col("c_custkey")
    state = market.pain_state(k % 11 != 0, k % 300, k * 7 % 401 - 200, k * 131 % 7200 * 1_000_000)
    return table(spark, d, "customer").select("c_custkey", state.alias("state"))


ACCOUNTS = (
    "c_nationkey AS market, c_custkey AS account, CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE 1 END AS side, CAST(abs(CAST(round(c_acctbal * 100) AS BIGINT)) + 1000 AS BIGINT) AS notional,"
    " CAST(c_custkey * 17 % 900 AS BIGINT) AS distance, CASE WHEN c_custkey % 5 = 0 THEN 20 ELSE 0 END AS band, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS collateral"
)


@query(None)
def cascade_paths(spark, d):
    """Liquidation cascades of every market for twelve shocks and three bounds."""
    return market.fragility(table(spark, d, "customer").selectExpr(*_split(ACCOUNTS)), 50_000_000, 100_000, 1_000_000)


def _split(exprs: str) -> list[str]:
    """Top-level comma split of a select list."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(exprs):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(exprs[at:i])
            at = i + 1
    return [x.strip() for x in [*out, exprs[at:]]]


@query(f"""WITH a AS (SELECT {ACCOUNTS} FROM customer), s AS (SELECT unnest([-500,-300,-200,-100,-50,-25,25,50,100,200,300,500]) AS shock)
SELECT market, shock, count(*) FILTER (distance + CASE WHEN side > 0 THEN shock ELSE -shock END <= 0) AS liquidated,
CAST(coalesce(sum(notional) FILTER (distance + CASE WHEN side > 0 THEN shock ELSE -shock END <= 0), 0) AS BIGINT) AS forced,
CAST(coalesce(sum(side * notional) FILTER (distance + CASE WHEN side > 0 THEN shock ELSE -shock END <= 0), 0) AS BIGINT) AS net FROM a, s GROUP BY ALL""")
def first_wave(spark, d):
    """Accounts, notional and net notional that the first wave of each shock liquidates."""
    a = table(spark, d, "customer").selectExpr(*_split(ACCOUNTS)).withColumn("shock", F.explode(F.array(*map(F.lit, market.SHOCKS))))
    gone = F.col("distance") + F.when(F.col("side") > 0, F.col("shock")).otherwise(-F.col("shock")) <= 0
    total = lambda c: F.coalesce(F.sum(F.when(gone, c)), F.lit(0))
    return a.groupBy("market", "shock").agg(F.count(F.when(gone, 1)).alias("liquidated"), total(F.col("notional")).alias("forced"), total(F.col("side") * F.col("notional")).alias("net"))


@query("""WITH m AS (SELECT vec_id AS episode, vec_id * 10 AS effective, vec_id * 10 + 5 AS known, list_transform(embedding[1:20], lambda x: CAST(round(x::DOUBLE * 1000) AS BIGINT)) AS v FROM embeddings),
q AS (SELECT vec_id AS query, vec_id AS q_episode, vec_id * 10 AS t_at, vec_id * 10 AS known_at, list_transform(embedding[1:20], lambda x: CAST(round(x::DOUBLE * 1000) AS BIGINT)) AS q FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT query, episode, effective, CAST(list_sum(list_transform(list_zip(v, q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance, list_transform(list_sort(list_transform(list_zip(v, q), lambda z, i: {'g': -abs(z[1] - z[2]), 'i': i - 1}))[:3], lambda s: CAST(s.i AS INTEGER)) AS dimensions FROM m, q WHERE episode <> q_episode AND known <= known_at AND effective < t_at - 100),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, episode, effective) AS rank, min(distance) OVER (PARTITION BY query) AS nearest FROM p)
SELECT query, episode, distance, rank, CASE WHEN nearest <= 600000 THEN 800000 ELSE 0 END AS support_ppm, dimensions FROM r WHERE rank <= 5""")
def knn_memory(spark, d):
    """Five nearest earlier episodes over 20 integer dimensions and the three dimensions that part them most, for every
    row whose id is divisible by 50."""
    v = F.transform(F.slice("embedding", 1, 20), lambda x: F.round(x.cast("double") * 1000).cast("bigint"))
    e = table(spark, d, "embeddings")
    memory = e.select(F.col("vec_id").alias("episode"), (F.col("vec_id") * 10).alias("effective"), (F.col("vec_id") * 10 + 5).alias("known"), v.alias("v"))
    now = (F.col("vec_id") * 10).alias
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("vec_id").alias("q_episode"), now("at"), now("known_at"), v.alias("q"))
    out = market.analogues(memory, asked, 5, 100, 600_000)
    return out.select("query", "episode", F.col("distance").cast("bigint").alias("distance"), F.col("rank").cast("bigint").alias("rank"), "support_ppm", market.contributing_dimensions("v", "q").alias("dimensions"))


@query(f"""WITH {EV}, m AS (SELECT user_id % 20 AS market, event_type, sum(CASE WHEN event_id % 2 = 0 THEN cents ELSE -cents END) AS signed, sum(cents) AS gross FROM ev GROUP BY ALL)
SELECT market, CAST(sum(signed) AS BIGINT) AS net, CAST(sum(gross) AS BIGINT) AS gross, CAST(sum(signed) * 1000000 // sum(gross) AS BIGINT) AS net_ppm, CAST(max(gross) * 1000000 // sum(gross) AS BIGINT) AS largest_ppm FROM m GROUP BY 1""")
def cross_asset(spark, d):
    """Net and gross exposure over the assets of a market."""
    ev = events(spark, d).withColumn("signed", F.when(F.col("event_id") % 2 == 0, F.col("cents")).otherwise(-F.col("cents")))
    m = ev.groupBy((F.col("user_id") % 20).alias("market"), "event_type").agg(F.sum("signed").alias("signed"), F.sum("cents").alias("gross"))
    t = m.groupBy("market").agg(F.sum("signed").alias("net"), F.sum("gross").alias("gross"), F.max("gross").alias("largest"))
    return t.select("market", "net", "gross", trunc_div(F.col("net") * PPM, "gross").alias("net_ppm"), trunc_div(F.col("largest") * PPM, "gross").alias("largest_ppm"))


@query("""WITH m AS (SELECT c_nationkey, c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS bal FROM customer)
SELECT c_nationkey, c_custkey, CAST(count(*) OVER (PARTITION BY c_nationkey ORDER BY bal) * 1000000 // count(*) OVER (PARTITION BY c_nationkey) AS BIGINT) AS percentile_ppm FROM m""")
def whale_percentile(spark, d):
    """Share of the market's members at or below each member's equity."""
    m = table(spark, d, "customer").select("c_nationkey", "c_custkey", cents("c_acctbal").alias("bal"))
    return stats.shares_upto(m, ["c_nationkey"], "bal", "percentile_ppm").drop("bal")
