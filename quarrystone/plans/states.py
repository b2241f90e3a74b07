"""Keyed states, classifiers and research tables: the remaining folds, gates and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.fixed import PPM, aligned, percent_encoded, scale_ppm, trunc_div, trunc_wide, wide
from ..operators import bitemporal as bt
from ..operators import ledger, market, research, signals, wallet
from .registry import EV, LI, cents, days, events, lines, query, table

def _shares(weights: str) -> str:
    """DuckDB: largest-remainder shares of rows (k, i, w)."""
    return (
        f"s AS (SELECT *, w * 1000000 // sum(w) OVER (PARTITION BY k) AS f, w * 1000000 % sum(w) OVER (PARTITION BY k) AS r FROM {weights}),"
        " p AS (SELECT k, i, CAST(f AS BIGINT) + CASE WHEN row_number() OVER (PARTITION BY k ORDER BY r DESC, i) <= 1000000 - sum(f) OVER (PARTITION BY k) THEN 1 ELSE 0 END AS ppm FROM s)"
    )


@query("""WITH x AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 <> 3 THEN c_custkey % 3 = 0 END AS flat, CASE WHEN c_custkey % 8 <> 7 THEN c_custkey % 2 = 0 END AS inc, c_custkey % 5 = 0 AS dec_, c_custkey % 7 = 0 AS lev,
 c_custkey % 11 = 0 AS hedge, c_custkey % 13 = 0 AS carry, c_custkey % 17 = 0 AS maker, c_custkey % 19 = 0 AS liq, c_custkey % 23 = 0 AS tr FROM customer),
y AS (SELECT *, CASE WHEN flat AND inc THEN 0 WHEN NOT flat AND inc THEN 1 WHEN dec_ AND lev THEN 2 WHEN NOT flat AND dec_ THEN 3 ELSE -1 END AS arm FROM x),
w AS (SELECT k, unnest(range(10)) AS i, unnest([1 + 40 * (arm = 0)::INT, 1 + 40 * (arm = 1)::INT, 1 + 40 * (arm = 2)::INT, 1 + 30 * (arm = 3)::INT, 1 + 35 * hedge::INT, 1 + 35 * carry::INT, 1 + 35 * maker::INT, 1 + 50 * liq::INT, 1 + 50 * tr::INT,
 CASE WHEN flat IS NULL AND inc IS NULL THEN 70 ELSE 1 END]) AS w FROM y), """ + _shares("w") + """
SELECT k AS c_custkey, list(ppm ORDER BY i) AS ppm FROM p GROUP BY 1""")
def intent_classify(spark, d):
    """Shares of ten intents from what an account just did; some inputs are unknown."""
    k = F.col("c_custkey")
    yes = lambda n: k % n == 0
    flat, increased = F.when(k % 4 != 3, yes(3)), F.when(k % 8 != 7, yes(2))
    w = wallet.intent_weights(flat, increased, yes(5), yes(7), yes(17), yes(13), yes(19), yes(23), yes(11))
    return table(spark, d, "customer").select("c_custkey", w.alias("w")).select("c_custkey", market.allocate_array(F.col("w")).alias("ppm"))


@query("""SELECT c_custkey, least(950000, 120000 * ((c_custkey % 2 = 0)::INT + (c_custkey % 3 = 0)::INT + (c_custkey % 4 = 0)::INT + (c_custkey % 5 = 0)::INT + (c_custkey % 6 = 0)::INT + (c_custkey % 7 = 0)::INT + (c_custkey % 8 = 0)::INT + (c_custkey % 9 = 0)::INT)) AS hedge_ppm FROM customer""")
def hedge_assessment(spark, d):
    """120,000 ppm for each hedge flag, 950,000 at most."""
    flags = sum(((F.col("c_custkey") % n == 0).cast("int") for n in range(2, 10)), F.lit(0))
    return table(spark, d, "customer").select("c_custkey", F.least(F.lit(950_000), flags * 120_000).alias("hedge_ppm"))


@query("""WITH c AS (SELECT o_custkey, o_orderkey % 8 AS part, max(o_orderkey * 7919 % 1000001) AS ppm FROM orders GROUP BY ALL)
SELECT o_custkey, count(*) AS parts, CASE WHEN count(*) = 8 THEN CAST(sum(ppm) AS BIGINT) // 8 END AS conviction FROM c GROUP BY 1""")
def conviction_mean(spark, d):
    """Mean of eight required components; withheld where one is missing."""
    c = table(spark, d, "orders").groupBy("o_custkey", (F.col("o_orderkey") % 8).alias("part")).agg(F.max(F.expr("o_orderkey * 7919 % 1000001")).alias("ppm"))
    t = c.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("parts"), F.sum("ppm").alias("s"))
    return t.select("o_custkey", "parts", F.when(F.col("parts") == 8, trunc_div("s", F.lit(8))).alias("conviction"))


@query(f"""WITH {LI}, f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, px, qty, lag(l_linenumber) OVER w AS before, sum(qty) OVER w AS filled FROM li WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, px ROWS UNBOUNDED PRECEDING))
SELECT l_orderkey, CAST(max(filled) AS BIGINT) AS filled, count(*) FILTER (before IS NOT NULL AND l_linenumber <= before) AS bad_index, max(filled) > 150 AS overfill FROM f GROUP BY 1""")
def twap_slices(spark, d):
    """Slices of a parent order: the index must increase, the total must not pass the order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "px")
    f = lines(spark, d).withColumn("before", F.lag("l_linenumber").over(w)).withColumn("filled", F.sum("qty").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = f.groupBy("l_orderkey").agg(F.max("filled").alias("filled"), F.count(F.when(F.col("l_linenumber") <= F.col("before"), 1)).alias("bad_index"))
    return t.withColumn("overfill", F.col("filled") > 150)


@query(f"""WITH {EV}, s AS (SELECT event_id, user_id, us, CASE event_type WHEN 'signup' THEN cents * 4 WHEN 'error' THEN -cents ELSE 0 END AS delta, event_type FROM ev),
r AS (SELECT *, sum(delta) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS open_qty FROM s)
SELECT event_id, CAST(open_qty AS BIGINT) AS open_qty, CASE WHEN open_qty < 0 THEN 'ambiguous' WHEN open_qty = 0 THEN 'settled' ELSE 'open' END AS state FROM r WHERE event_type IN ('signup', 'error')""")
def liquidation_fills(spark, d):
    """Liquidated quantity still open after each fill; an overrun is ambiguous."""
    delta = F.when(F.col("event_type") == "signup", F.col("cents") * 4).when(F.col("event_type") == "error", -F.col("cents")).otherwise(0)
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    r = events(spark, d).withColumn("open_qty", F.sum(delta).over(w)).where("event_type in ('signup', 'error')")
    return r.select("event_id", "open_qty", F.when(F.col("open_qty") < 0, "ambiguous").when(F.col("open_qty") == 0, "settled").otherwise("open").alias("state"))


@query(f"""WITH {EV}, o AS (SELECT user_id, event_id, us, cents FROM ev WHERE event_type = 'signup'), t AS (SELECT user_id, min(us) AS first_us, arg_min(cents, (us, event_id)) AS trigger_px FROM ev WHERE event_type = 'purchase' GROUP BY 1)
SELECT o.event_id, t.first_us IS NOT NULL AND t.first_us <= o.us AS active, CASE WHEN t.first_us <= o.us THEN t.trigger_px END AS trigger_px FROM o LEFT JOIN t USING (user_id)""")
def trigger_activation(spark, d):
    """Orders whose trigger was active before them, and at what price."""
    ev = events(spark, d)
    t = ev.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("us").alias("first_us"), F.min_by("cents", F.struct("us", "event_id")).alias("px"))
    o = ev.where("event_type = 'signup'").select("user_id", "event_id", "us").join(t, "user_id", "left")
    active = F.coalesce(F.col("first_us") <= F.col("us"), F.lit(False))
    return o.select("event_id", active.alias("active"), F.when(active, F.col("px")).alias("trigger_px"))


@query("""WITH v AS (SELECT o_custkey % 100 AS market, epoch_us(o_orderdate) // 86400000000 AS day, max(o_orderkey) AS version FROM orders GROUP BY ALL)
SELECT market, version, day AS effective_from, lead(day) OVER (PARTITION BY market ORDER BY day) - 1 AS effective_to FROM v""")
def metadata_ranges(spark, d):
    """Validity range of each market's metadata version."""
    v = table(spark, d, "orders").groupBy((F.col("o_custkey") % 100).alias("market"), days("o_orderdate").alias("effective_from")).agg(F.max("o_orderkey").alias("version"))
    nxt = F.lead("effective_from").over(Window.partitionBy("market").orderBy("effective_from"))
    return v.withColumn("effective_to", nxt - 1)


@query(f"""WITH {LI}, a AS (SELECT l_orderkey, l_linenumber, sum(px) AS v1, count(*) AS n1 FROM li GROUP BY ALL), b AS (SELECT l_orderkey, l_linenumber, sum(px) + max(CASE WHEN l_orderkey % 37 = 0 THEN 1 ELSE 0 END) AS v2 FROM li WHERE l_linestatus = 'O' GROUP BY ALL)
SELECT l_orderkey, l_linenumber, CASE WHEN v2 IS NULL THEN 'MissingV2' WHEN v1 = v2 THEN 'Reconciled' ELSE 'Conflict' END AS state FROM a LEFT JOIN b USING (l_orderkey, l_linenumber)""")
def trade_reconciliation(spark, d):
    """First-version trade facts against second-version ones."""
    li = lines(spark, d)
    a = li.groupBy("l_orderkey", "l_linenumber").agg(F.sum("px").alias("v1"))
    b = li.where("l_linestatus = 'O'").groupBy("l_orderkey", "l_linenumber").agg(F.sum("px").alias("v2")).withColumn("v2", F.col("v2") + F.when(F.col("l_orderkey") % 37 == 0, 1).otherwise(0))
    state = F.when(F.col("v2").isNull(), "MissingV2").when(F.col("v1") == F.col("v2"), "Reconciled").otherwise("Conflict")
    return a.join(b, ["l_orderkey", "l_linenumber"], "left").select("l_orderkey", "l_linenumber", state.alias("state"))


@query(f"""WITH {EV}, t AS (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN cents WHEN event_type = 'purchase' THEN -cents END AS sg FROM ev),
r AS (SELECT *, sum(coalesce(sg, 0)) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS result FROM t),
n AS (SELECT *, sum(CASE WHEN sg IS NOT NULL AND ((result - sg = 0 AND result <> 0) OR sign(result - sg) * sign(result) < 0) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS episode FROM r)
SELECT user_id, CAST(CASE WHEN result <> 0 THEN episode END AS BIGINT) AS episode, CAST(sum(CASE WHEN cents % 2 = 0 THEN cents ELSE -cents END) AS BIGINT) AS funding, count(*) AS payments FROM n WHERE sg IS NULL GROUP BY ALL""")
def funding_attribution(spark, d):
    """Funding payments to the episode open at the time; null where the position is flat."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    sg = F.when(F.col("event_type").isin("click", "view"), F.col("cents")).when(F.col("event_type") == "purchase", -F.col("cents"))
    r = events(spark, d).withColumn("sg", sg).withColumn("result", F.sum(F.coalesce("sg", F.lit(0))).over(w)).withColumn("start", F.col("result") - F.col("sg"))
    opens = ((F.col("start") == 0) & (F.col("result") != 0)) | (F.signum("start") * F.signum("result") < 0)
    n = r.withColumn("n", F.sum(F.when(F.col("sg").isNotNull() & opens, 1).otherwise(0)).over(w)).where("sg is null")
    paid = F.when(F.col("cents") % 2 == 0, F.col("cents")).otherwise(-F.col("cents"))
    return n.groupBy("user_id", F.when(F.col("result") != 0, F.col("n")).alias("episode")).agg(F.sum(paid).alias("funding"), F.count(F.lit(1)).alias("payments"))


@query(f"""WITH {EV}, l AS (SELECT 'vault' AS account, user_id % 9 AS id, CASE event_type WHEN 'signup' THEN cents WHEN 'purchase' THEN -cents END AS delta FROM ev WHERE event_type IN ('signup', 'purchase')
UNION ALL SELECT 'member', user_id, CASE event_type WHEN 'signup' THEN -cents WHEN 'purchase' THEN cents END FROM ev WHERE event_type IN ('signup', 'purchase'))
SELECT account, id, CAST(sum(greatest(delta, 0)) AS BIGINT) AS credit, CAST(sum(greatest(-delta, 0)) AS BIGINT) AS debit FROM l GROUP BY ALL""")
def vault_principal(spark, d):
    """Vault deposits and distributions mirrored on the members."""
    ev = events(spark, d).where("event_type in ('signup', 'purchase')").withColumn("vault", F.col("user_id") % 9)
    rules = {"signup": [("vault", "vault", 1), ("user_id", "member", -1)], "purchase": [("vault", "vault", -1), ("user_id", "member", 1)]}
    t = ledger.balances(ledger.signed_legs(ev, rules, "event_type", "cents"))
    return t.select(F.col("scope").alias("account"), F.col("account").alias("id"), "credit", "debit")


@query(f"""WITH {EV} SELECT event_id % 7 AS validator, CAST(sum(cents) AS BIGINT) AS rewards, min(us) AS first, max(us) AS last FROM ev WHERE event_type = 'signup' GROUP BY 1""")
def validator_rewards(spark, d):
    """Rewards of each validator and the range they were paid in."""
    ev = events(spark, d).where("event_type = 'signup'")
    return ev.groupBy((F.col("event_id") % 7).alias("validator")).agg(F.sum("cents").alias("rewards"), F.min("us").alias("first"), F.max("us").alias("last"))


@query(f"""WITH {EV}, s AS (SELECT user_id, event_id * 7919 % 2001 - 1000 AS p, cents - 6000 AS y FROM ev)
SELECT user_id, count(*) AS n, count(*) FILTER (sign(p) = sign(y)) AS hits, count(*) FILTER (sign(p) = sign(y)) * 1000000 // count(*) AS hit_ppm, CAST(sum(y) AS BIGINT) // count(*) AS mean FROM s GROUP BY 1""")
def hit_rate(spark, d):
    """Share of predictions with the outcome's sign, and the truncated mean outcome."""
    s = events(spark, d).withColumn("p", F.expr("event_id * 7919 % 2001 - 1000")).withColumn("y", F.col("cents") - 6000)
    t = s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(research.hit(F.col("p"), F.col("y")), 1)).alias("hits"), F.sum("y").alias("s"))
    return t.select("user_id", "n", "hits", trunc_div(F.col("hits") * PPM, "n").alias("hit_ppm"), trunc_div("s", "n").alias("mean"))


@query(f"""WITH {EV}, e AS (SELECT user_id, event_type, CAST(sum(cents - 6000) AS BIGINT) AS v FROM ev GROUP BY ALL), t AS (SELECT *, sum(abs(v)) OVER (PARTITION BY user_id) AS total FROM e)
SELECT user_id, event_type, v, CASE WHEN total <> 0 THEN CAST(abs(v) * 1000000 // total AS BIGINT) END AS share_ppm FROM t""")
def episode_shares(spark, d):
    e = events(spark, d).groupBy("user_id", "event_type").agg(F.sum(F.col("cents") - 6000).alias("v"))
    return research.episode_shares(e, ["user_id"], "v").select("user_id", "event_type", "v", "share_ppm")


@query("""WITH e AS (SELECT c_custkey, c_custkey % 150 AS outcomes, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 130 END AS days, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey * 7919 % 400000 END AS share, c_custkey % 5 = 0 AS prob, c_custkey % 6 = 0 AS shadow, c_custkey % 8 = 0 AS locked FROM customer),
g AS (SELECT c_custkey, unnest([
 {'gate': 'independent_outcomes', 'f': outcomes < 100, 'bad': 'insufficient_independent_outcomes', 'r': 'no_locked_holdout'},
 {'gate': 'calendar_coverage', 'f': coalesce(days < 90, false), 'bad': 'insufficient_calendar_coverage', 'r': CASE WHEN days IS NULL THEN 'calendar_unmodeled' ELSE 'no_locked_holdout' END},
 {'gate': 'net_expectancy_bootstrap', 'f': false, 'bad': '', 'r': 'significance_not_claimed'}, {'gate': 'cost_stress', 'f': false, 'bad': '', 'r': 'cost_stress_unmodeled'}, {'gate': 'latency_stress', 'f': false, 'bad': '', 'r': 'latency_stress_unmodeled'},
 {'gate': 'concentration', 'f': coalesce(share > 200000, false), 'bad': 'episode_share_exceeds_policy', 'r': CASE WHEN share IS NULL THEN 'episode_shares_unmodeled' ELSE 'no_locked_holdout' END},
 {'gate': 'drawdown', 'f': false, 'bad': '', 'r': 'no_preregistered_holdout_budget'}, {'gate': 'calibration', 'f': prob, 'bad': 'probability_display_forbidden', 'r': 'uncalibrated'},
 {'gate': 'capacity', 'f': false, 'bad': '', 'r': 'synthetic_linear_only'}, {'gate': 'shadow_live', 'f': shadow, 'bad': 'shadow_live_not_production', 'r': 'shadow_live_not_implemented'},
 {'gate': 'reproducibility', 'f': false, 'bad': '', 'r': 'two_builder_reproduction_unmodeled'}, {'gate': 'locked_holdout', 'f': locked, 'bad': 'holdout_pass_not_implemented', 'r': 'no_locked_holdout'}]) AS g FROM e)
SELECT c_custkey, g.gate AS gate, CASE WHEN g.f THEN 'Fail' ELSE 'Withheld' END AS decision, CASE WHEN g.f THEN g.bad ELSE g.r END AS reason, false AS promoted FROM g""")
def promotion_gates(spark, d):
    """The twelve promotion gates of each candidate, with their reasons."""
    e = table(spark, d, "customer").selectExpr(
        "c_custkey", "c_custkey % 150 AS outcomes", "if(c_custkey % 7 <> 0, c_custkey % 130, null) AS days", "if(c_custkey % 11 <> 0, c_custkey * 7919 % 400000, null) AS largest_share_ppm",
        "c_custkey % 5 = 0 AS as_probability", "c_custkey % 6 = 0 AS shadow_live", "c_custkey % 8 = 0 AS locked",
    )
    return research.promotion(e).select("c_custkey", F.inline("gates"), "promoted")


RULES = ["OriginatorExposureClosed", "FlowBelow", "IndependenceBelow", "CostAboveEdge", "DataHealthNotGreen", "BookHealthNotGreen", "TimeExpired", "CustomApproved", "Unheard"]


@query("""WITH x AS (SELECT c_custkey, c_custkey % 9 AS kind, c_custkey * 7 % 1000 AS x, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 7 % 1000 END AS flow, c_custkey * 3 % 100 > c_custkey * 5 % 100 AS dear, c_custkey % 4 = 0 AS red, c_custkey % 3 = 0 AS amber FROM customer)
SELECT c_custkey, CASE kind WHEN 0 THEN x >= 500 WHEN 1 THEN coalesce(flow < 500, true) WHEN 2 THEN x < 500 WHEN 3 THEN dear WHEN 4 THEN red WHEN 5 THEN amber WHEN 6 THEN x >= 500 WHEN 7 THEN false END AS triggered,
CAST(CASE kind WHEN 0 THEN greatest(500 - x, 0) WHEN 2 THEN greatest(x - 500, 0) WHEN 7 THEN 1000000 WHEN 8 THEN NULL ELSE 0 END AS BIGINT) AS distance_ppm FROM x""")
def invalidation_rules(spark, d):
    """Whether each of the eight kinds of rule triggers and how far it is; an unknown kind is withheld."""
    k = F.col("c_custkey")
    kind = F.get(F.array(*map(F.lit, RULES)), (k % 9).cast("int"))
    x, flow = k * 7 % 1000, F.when(k % 5 != 0, k * 7 % 1000)
    data, book = F.when(k % 4 == 0, "Red").otherwise("Green"), F.when(k % 3 == 0, "Amber").otherwise("Green")
    got = signals.invalidated(kind, x, flow, x, k * 3 % 100 > k * 5 % 100, data, book, x, F.lit(500))
    return table(spark, d, "customer").select("c_custkey", got.alias("s")).select("c_custkey", "s.triggered", "s.distance_ppm")


@query("""SELECT c_custkey, list_filter(['book', 'fills', 'inventory', 'model', 'provenance'], lambda x, i: c_custkey % (i + 2) = 0) AS missing FROM customer""")
def evidence_missing(spark, d):
    """Names of the evidence an admission still needs, in order."""
    names = ["book", "fills", "inventory", "model", "provenance"]
    return table(spark, d, "customer").select("c_custkey", signals.reasons(*[(n, F.col("c_custkey") % (i + 3) == 0) for i, n in enumerate(names)]).alias("missing"))


@query(f"""WITH {LI}, b AS (SELECT l_suppkey, sum(px) FILTER (l_linenumber % 2 = 0) AS l, sum(px) FILTER (l_linenumber % 2 = 1) AS s, sum(tax) AS m FROM li GROUP BY 1)
SELECT l_suppkey, CAST(coalesce(l, 0) * 1000 // m AS BIGINT) AS long_beta, CAST(coalesce(s, 0) * 1000 // m AS BIGINT) AS short_beta FROM b WHERE m <> 0""")
def long_short_beta(spark, d):
    """Returns of each side over the market's; markets without a return are left out."""
    side = lambda k: F.coalesce(F.sum(F.when(F.col("l_linenumber") % 2 == k, F.col("px"))), F.lit(0))
    b = lines(spark, d).groupBy("l_suppkey").agg(side(0).alias("l"), side(1).alias("s"), F.sum("tax").alias("m")).where("m <> 0")
    return b.select("l_suppkey", trunc_div(F.col("l") * 1000, "m").alias("long_beta"), trunc_div(F.col("s") * 1000, "m").alias("short_beta"))


@query(f"""WITH {LI} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, px, px * (50 + tax) // 1000000 AS fee, px * 3 // 10000 AS slippage, px * (disc * least(qty, 30) // 30) // 10000 AS impact, least(qty, 30 * 400000 // 1000000) AS capped FROM li""")
def fill_costs(spark, d):
    """Fee, slippage, participation impact and capped quantity of each fill."""
    impact = F.expr("px * (disc * least(qty, 30L) div 30) div 10000")
    return lines(spark, d).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "px", F.expr("px * (50 + tax) div 1000000").alias("fee"), F.expr("px * 3 div 10000").alias("slippage"),
        impact.alias("impact"), F.least("qty", scale_ppm(F.lit(30), F.lit(400_000))).alias("capped"),
    )


@query("""WITH p AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) // 86400000000 AS t FROM orders), s AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) // 86400000000 AS t FROM orders WHERE o_orderstatus = 'F')
SELECT id, t FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.id = p.id AND s.t = p.t)""")
def time_page(spark, d):
    """Records of a page that were not already seen at its boundary time."""
    from ..sources.archive import page_outcome

    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), days("o_orderdate").alias("time"), "o_orderstatus")
    return page_outcome(p, p.where("o_orderstatus = 'F'")).select("id", F.col("time").alias("t"))


@query("""WITH d AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) // 86400000000 AS decided FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) // 86400000000 + o_orderkey % 9 AS observed, CAST(round(o_totalprice * 100) AS BIGINT) AS net FROM orders WHERE o_orderpriority <> '1-URGENT')
SELECT d.id, o.net, CASE WHEN o.id IS NULL THEN 'Pending' WHEN o.observed < d.decided + 3 THEN 'TooEarly' ELSE 'Recorded' END AS state FROM d LEFT JOIN o USING (id)""")
def shadow_outcomes(spark, d):
    """Shadow decisions against their outcomes, with the horizon respected."""
    o = table(spark, d, "orders").withColumn("day", days("o_orderdate"))
    dec = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("day").alias("decided"))
    out = o.where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("id"), (F.col("day") + F.col("o_orderkey") % 9).alias("observed"), cents("o_totalprice").alias("net"))
    state = F.when(F.col("observed").isNull(), "Pending").when(F.col("observed") < F.col("decided") + 3, "TooEarly").otherwise("Recorded")
    return dec.join(out, "id", "left").select("id", "net", state.alias("state"))


@query(f"""WITH {EV}, t AS (SELECT 'Green' AS trust, 'click' AS kind, 'publish' AS lane UNION ALL SELECT 'Green', 'view', 'publish' UNION ALL SELECT 'Amber', 'click', 'hold' UNION ALL SELECT 'Red', 'click', 'quarantine')
SELECT event_id, coalesce(lane, 'refuse') AS lane FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'Green' WHEN 1 THEN 'Amber' ELSE 'Red' END AS trust FROM ev) e LEFT JOIN t ON t.trust = e.trust AND t.kind = e.event_type""")
def trust_lanes(spark, d):
    """Publication lane by source trust and observation class; what the table lacks is refused."""
    rules = spark.sql("SELECT * FROM VALUES ('Green','click','publish'),('Green','view','publish'),('Amber','click','hold'),('Red','click','quarantine') AS t(trust, event_type, lane)")
    ev = events(spark, d).withColumn("trust", F.when(F.col("event_id") % 3 == 0, "Green").when(F.col("event_id") % 3 == 1, "Amber").otherwise("Red"))
    return ev.join(F.broadcast(rules), ["trust", "event_type"], "left").select("event_id", F.coalesce("lane", F.lit("refuse")).alias("lane"))


@query("""WITH t AS (SELECT o_orderkey, epoch_us(o_orderdate) // 86400000000 AS day FROM orders), x AS (SELECT * FROM t WHERE day BETWEEN 9200 AND 10200)
SELECT o_orderkey FROM x WHERE day <= 10400 AND day + o_orderkey % 90 >= 10230""")
def label_leakage(spark, d):
    """Training rows whose label reaches into the validation range."""
    t = table(spark, d, "orders").select("o_orderkey", days("o_orderdate").alias("label_start"), (days("o_orderdate") + F.col("o_orderkey") % 90).alias("label_end"))
    fold = {"validation_from": 10230, "validation_to": 10400}
    return research.leakage(t.where("label_start between 9200 and 10200"), fold).select("o_orderkey")


@query("""SELECT c_custkey, c_custkey * 7919 % 1000000 AS turnover, CAST(CAST(c_custkey * 7919 % 1000000 AS HUGEINT) * 1000000 // (CAST(round(abs(c_acctbal) * 100) AS BIGINT) + 1) AS BIGINT) AS turnover_ppm,
coalesce(least(1000000, greatest(0, 1000000 - 4 * (c_custkey * 31 % 400000))), 0) AS fill_ppm FROM customer""")
def capacity_curve(spark, d):
    """Turnover against equity and fill probability of a size."""
    k = F.col("c_custkey")
    turn = k * 7919 % 1000000
    equity = F.expr("cast(round(abs(c_acctbal) * 100) as bigint)") + 1
    fill = F.least(F.lit(PPM), F.greatest(F.lit(0), F.lit(PPM) - (k * 31 % 400000) * 4))
    return table(spark, d, "customer").select("c_custkey", turn.alias("turnover"), trunc_wide(wide(turn) * PPM, equity).cast("bigint").alias("turnover_ppm"), fill.alias("fill_ppm"))


@query(f"""WITH {EV}, m AS (SELECT user_id AS member, us AS known, event_id, event_type AS cluster FROM ev WHERE event_type IN ('click', 'view'))
SELECT event_id, member, cluster, known FROM m WHERE known <= 1705276800000000 QUALIFY row_number() OVER (ORDER BY known DESC, event_id DESC) = 1""")
def membership_asof(spark, d):
    """Latest membership known at a time: one row for all accounts, as the rule has no account key."""
    m = events(spark, d).where("event_type in ('click', 'view') and us <= 1705276800000000").select("event_id", F.col("user_id").alias("member"), F.col("event_type").alias("cluster"), F.col("us").alias("known"))
    return bt.latest(m.withColumn("o", F.col("event_id")), [], ["known", "o"], ["event_id", "member", "cluster", "known"])


@query("""SELECT c_custkey, s AS state, CASE s WHEN 'Unknown' THEN 0 WHEN 'NearBreakEven' THEN 600000 WHEN 'Underwater' THEN 600000 WHEN 'Profitable' THEN 750000 WHEN 'VoluntaryExit' THEN 750000 WHEN 'NearLiquidation' THEN 850000 END::BIGINT AS confidence_ppm
FROM (SELECT c_custkey, ['Unknown', 'NearBreakEven', 'Underwater', 'Profitable', 'VoluntaryExit', 'NearLiquidation', 'Other'][1 + c_custkey % 7] AS s FROM customer)""")
def pain_confidences(spark, d):
    """Confidence of each pain state; a state that is not one is withheld."""
    order = ["Unknown", "NearBreakEven", "Underwater", "Profitable", "VoluntaryExit", "NearLiquidation", "Other"]
    names = F.array(*map(F.lit, order))
    c = table(spark, d, "customer").select("c_custkey", F.get(names, (F.col("c_custkey") % 7).cast("int")).alias("state"))
    return c.withColumn("confidence_ppm", market.pain_confidence(F.col("state")))


@query(f"""WITH {LI}, x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, px, qty, (l_partkey % 9 - 1) * 5 AS tick, l_suppkey % 4 AS lot FROM li)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, px, coalesce(tick > 0 AND px % nullif(tick, 0) = 0, false) AS on_tick, coalesce(tick > 0 AND px * 100 % nullif(tick, 0) = 0, false) AS on_fine_tick, coalesce(lot > 0 AND qty % nullif(lot * 10, 0) = 0, false) AS on_lot FROM x""")
def tick_alignment(spark, d):
    """Prices and sizes that are whole ticks and lots, at equal, finer and coarser scales."""
    x = lines(spark, d).withColumn("tick", F.expr("(l_partkey % 9 - 1) * 5")).withColumn("lot", F.col("l_suppkey") % 4)
    checks = {"on_tick": aligned("px", "tick", 2, 2), "on_fine_tick": aligned("px", "tick", 2, 4), "on_lot": aligned("qty", "lot", 1, 0)}
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "px", *[c.alias(n) for n, c in checks.items()])


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) - 15000000 AS y FROM orders),
f AS (SELECT o_custkey, CAST(sum(y) AS BIGINT) // count(*) AS mean, arg_max(y, o_orderkey) AS last FROM o GROUP BY 1)
SELECT o_custkey, unnest(['MeanOutcome', 'NoTrade', 'Momentum', 'MeanReversion', 'RawFeature']) AS class, unnest([mean, 0, last, mean, 0])::BIGINT AS intercept, unnest([0, 0, 0, -100000000, 100000000])::BIGINT AS weight FROM f""")
def baseline_estimators(spark, d):
    """Five baseline estimators of each key's outcomes."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", (cents("o_totalprice") - 15_000_000).alias("y"), (F.col("o_orderkey") % 100).alias("x"))
    return research.baselines(o, "o_custkey", ["o_orderkey"], "x", "y")


@query("""SELECT c_nationkey, count(CASE WHEN c_custkey % 3 = 0 AND c_nationkey % 5 <> 0 THEN 1 END) AS attempted_variants, greatest(count(CASE WHEN c_custkey % 3 = 0 AND c_nationkey % 5 <> 0 THEN 1 END), 1) AS bonferroni_divisor,
CASE WHEN count(CASE WHEN c_custkey % 3 = 0 AND c_nationkey % 5 <> 0 THEN 1 END) = 0 THEN 'empty_family' ELSE 'no_locked_holdout' END AS withheld_reason FROM customer GROUP BY 1""")
def multiple_testing(spark, d):
    """Attempts of each family and the divisor they impose."""
    v = table(spark, d, "customer").select("c_nationkey", F.expr("if(c_custkey % 3 = 0 and c_nationkey % 5 <> 0, c_custkey, null)").alias("variant"))
    return research.multiple_testing(v, "c_nationkey")


@query(f"""WITH {EV}, r AS (SELECT user_id, cents - 6000 AS x, row_number() OVER (PARTITION BY user_id ORDER BY cents) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM ev)
SELECT user_id, n, CAST(CAST(sum(x) FILTER (n >= 20 AND k <= greatest(n * 5 // 100, 1)) AS BIGINT) // nullif(count(*) FILTER (n >= 20 AND k <= greatest(n * 5 // 100, 1)), 0) AS BIGINT) AS es FROM r GROUP BY 1, 2""")
def research_shortfall(spark, d):
    """Mean of the floor(5 %) worst outcomes, withheld below twenty."""
    return research.shortfalls(events(spark, d).withColumn("x", F.col("cents") - 6000), "user_id", "x")


@query("""WITH m AS (SELECT c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT) AS bal, c_custkey AS k FROM customer),
x AS (SELECT c_nationkey, k % 100 >= 30 AND k % 17 <> 0 AS num, k % 100 >= 10 AND k % 17 <> 0 AND c_nationkey <> 3 AS den, unnest(['IndependentEntityCount', 'GrossExposure', 'NewRiskFlow', 'HighConvictionFlow', 'LiquidationWeightedExposure', 'TakerOpeningFlow', 'SmartCrowdDivergence']) AS measure,
 unnest([k * 31 % 1000, abs(bal), bal, bal // 2, k * 13 % 5000, bal * (k % 3 - 1), bal]) AS v, k * 31 % 1000 AS w FROM m),
s AS (SELECT c_nationkey, measure, CAST(coalesce(sum(v) FILTER (num), 0) AS BIGINT) AS numerator, CAST(coalesce(sum(v) FILTER (den), 0) AS BIGINT) AS denominator, CAST((coalesce(sum(w) FILTER (num), 0) + coalesce(sum(w) FILTER (den), 0)) // 2 AS BIGINT) AS ess_milli FROM x GROUP BY ALL)
SELECT c_nationkey, measure, numerator, denominator, CAST(CASE WHEN denominator = 0 THEN NULL WHEN measure = 'SmartCrowdDivergence' THEN numerator - denominator ELSE CAST(numerator AS HUGEINT) * 100000000 // denominator END AS BIGINT) AS value, ess_milli, least(ess_milli, 1000000) AS confidence_ppm FROM s""")
def cohort_measures(spark, d):
    """Seven measures of two cohorts, with exclusions; withheld where the denominator is zero."""
    m = table(spark, d, "customer").withColumn("bal", cents("c_acctbal")).selectExpr(
        "c_nationkey", "c_custkey AS k", "c_custkey * 31 % 1000 AS weight_ppm", "abs(bal) AS gross", "bal AS new_risk", "bal div 2 AS high_conviction",
        "c_custkey * 13 % 5000 AS liquidation_weighted", "bal * (c_custkey % 3 - 1) AS taker_opening",
    )
    k = F.col("k")
    return market.cohort_measures(m, "c_nationkey", k % 100 >= 30, (k % 100 >= 10) & (F.col("c_nationkey") != 3), k % 17 == 0)


@query("""SELECT p_partkey, CAST(p_partkey % 200 - 100 + p_size + p_partkey % 7 AS BIGINT) AS break_even FROM part""")
def break_even(spark, d):
    """Break-even of an entry after fees and funding, in basis points."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 200 - 100).alias("entry"), F.col("p_size").cast("bigint").alias("fees"), (F.col("p_partkey") % 7).alias("funding"))
    return p.select("p_partkey", market.break_even_bps("entry", "fees", "funding").alias("break_even"))


@query(r"""WITH p AS (SELECT p_partkey, p_name || '/é%' || p_partkey || '._-~' AS name FROM part)
SELECT p_partkey, list_aggregate(list_transform(string_split(regexp_replace(hex(encode(name)), '(..)', '\1 ', 'g'), ' ')[:-2], lambda x: CASE WHEN regexp_full_match(x, '2[DE]|3[0-9]|4[1-9A-F]|5[0-9A]|5F|6[1-9A-F]|7[0-9A]') THEN decode(unhex(x)) ELSE '%' || x END), 'string_agg', '') AS encoded FROM p""")
def encoded_components(spark, d):
    """Path components, percent-encoded byte by byte."""
    name = F.concat("p_name", F.lit("/é%"), F.col("p_partkey").cast("string"), F.lit("._-~"))
    return table(spark, d, "part").select("p_partkey", percent_encoded(name).alias("encoded"))
