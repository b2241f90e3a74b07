"""Market intelligence: flow, cohorts, crowding, allocation, regimes, memory, fragility, pain."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import PPM, big, clamp, floor_div, product_ppm, scale_ppm, trunc_div, trunc_wide, wide
from ..functions.stats import squared_distance


def risk_sign(kind: Column) -> Column:
    """+1 opens or adds long (or reduces short), -1 the reverse; closes and static positions add no new risk."""
    return (
        F.when(kind.isin("OpenLong", "AddLong", "ReduceShort"), 1).when(kind.isin("OpenShort", "AddShort", "ReduceLong"), -1).otherwise(0)
    ).cast("bigint")


def edge_weight(edge_bps) -> Column:
    return clamp(big(edge_bps) * 5000 + 500_000, 0, PPM)


def weighted_flow(sign: Column, notional: Column, *factors) -> Column:
    return scale_ppm(sign * notional, product_ppm(*factors))


def liquidity_denominator(terms: list[tuple[Column, int, int]]) -> Column:
    """Sum of max(value, minimum) * weight / 1e6 over (value, minimum, weight ppm); the weights make 1e6."""
    if sum(w for *_, w in terms) != PPM:
        raise ValueError("weights must make 1e6")
    total = None
    for value, least, w in terms:
        part = wide(F.greatest(value, F.lit(least))) * w
        total = part if total is None else total + part
    return trunc_wide(total, F.lit(PPM)).cast("bigint")


def allocate_ppm(df: DataFrame, keys: list[str], weight: str, index: str, out: str = "ppm") -> DataFrame:
    """Largest-remainder shares of exactly 1e6 for each key; leftover units go to the largest remainders, then by index."""
    total = F.sum(wide(weight)).over(Window.partitionBy(*keys))
    scaled = wide(weight) * PPM
    df = df.withColumn("_f", trunc_wide(scaled, total).cast("bigint")).withColumn("_r", scaled % total)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_r").desc(), index))
    left = F.lit(PPM) - F.sum("_f").over(Window.partitionBy(*keys))
    return df.withColumn(out, F.col("_f") + F.when(rank <= left, 1).otherwise(0)).drop("_f", "_r")


def allocate_array(weights: Column) -> Column:
    """``allocate_ppm`` inside a row: an array of weights to an array of shares."""
    total = F.aggregate(weights, F.lit(0).cast("bigint"), lambda a, x: a + x)
    parts = F.transform(weights, lambda x, i: F.struct((-((x * PPM) % total)).alias("r"), i.alias("i"), trunc_div(x * PPM, total).alias("f")))
    left = F.lit(PPM) - F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a + p["f"])
    ranked = F.transform(F.array_sort(parts), lambda p, k: F.struct(p["i"].alias("i"), (p["f"] + F.when(k < left, 1).otherwise(0)).alias("ppm")))
    return F.transform(F.array_sort(ranked), lambda p: p["ppm"])


# --- cohorts: an ordered, fail-closed predicate language -------------------------------------------------------


@dataclass(frozen=True)
class AtLeast:
    field: str
    value: int


@dataclass(frozen=True)
class Equals:
    field: str
    value: str


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


def _state(p) -> Column:
    """'T', 'F' or 'E' (a missing input was needed)."""
    if isinstance(p, AtLeast):
        return F.when(F.col(p.field).isNull(), "E").when(F.col(p.field) >= p.value, "T").otherwise("F")
    if isinstance(p, Equals):
        return F.when(F.col(p.field).isNull(), "E").when(F.col(p.field) == p.value, "T").otherwise("F")
    if isinstance(p, Not):
        s = _state(p.part)
        return F.when(s == "E", "E").when(s == "T", "F").otherwise("T")
    states = [_state(x) for x in p.parts]
    if isinstance(p, And):  # the first that is not true decides
        out = F.lit("T")
        for s in reversed(states):
            out = F.when(s == "T", out).otherwise(s)
        return out
    any_true, any_error = F.lit(False), F.lit(False)  # a true part answers, whatever is missing
    for s in states:
        any_true, any_error = any_true | (s == "T"), any_error | (s == "E")
    return F.when(any_true, "T").when(any_error, "E").otherwise("F")


def matches(predicate, missing: str = "raise") -> Column:
    """Boolean column; where a needed input is missing it raises, or is null with ``missing='withhold'``."""
    s = _state(predicate)
    lost = F.raise_error(F.lit("cohort input missing")).cast("boolean") if missing == "raise" else F.lit(None).cast("boolean")
    return F.when(s == "T", True).when(s == "F", False).otherwise(lost)


# --- crowding, entries ------------------------------------------------------------------------------------------


def euclid_bin(x, width: int) -> Column:
    return floor_div(x, F.lit(width)).cast("bigint")


def hhi(df: DataFrame, keys: list[str], value: str, unit: int, cap: int, out: str = "hhi") -> DataFrame:
    """Sum of squared shares, each share truncated at ``unit``; capped.  The totals are one row a key and are joined."""
    total = df.groupBy(*[F.col(k).alias(f"_t_{k}") for k in keys]).agg(F.sum(value).alias("_total"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys])
    share = trunc_div(F.col(value) * unit, "_total")
    return df.join(total, same).withColumn("_s", share).groupBy(*keys).agg(F.least(F.sum(F.col("_s") * F.col("_s")), F.lit(cap)).alias(out))


#: Measures of a cohort and the input each sums (fixed values); the divergence is a difference, the others are ratios.
COHORT_MEASURES = {
    "IndependentEntityCount": "weight_ppm", "GrossExposure": "gross", "NewRiskFlow": "new_risk", "HighConvictionFlow": "high_conviction",
    "LiquidationWeightedExposure": "liquidation_weighted", "TakerOpeningFlow": "taker_opening", "SmartCrowdDivergence": "new_risk",
}


def cohort_measures(members: DataFrame, key: str, numerator: Column, denominator: Column, excluded: Column | None = None) -> DataFrame:
    """(key, measure, numerator, denominator, value_e8, ess_milli, confidence_ppm): two cohorts by every measure.

    A ratio or difference is withheld (null) where the denominator is zero; excluded members are in neither cohort;
    the effective sample is the mean of both cohorts' weights.
    """
    kept = F.lit(True) if excluded is None else ~F.coalesce(excluded, F.lit(False))
    cohorts = members.withColumns({"_num": numerator & kept, "_den": denominator & kept})
    inputs = sorted(set(COHORT_MEASURES.values()))
    sums = [F.coalesce(F.sum(F.when(F.col(c), wide(x))), F.lit(0)).cast("decimal(38,0)").alias(f"{c}_{x}") for c in ("_num", "_den") for x in inputs]
    out = cohorts.groupBy(key).agg(*sums)
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"_num_{x}").alias("numerator"), F.col(f"_den_{x}").alias("denominator")) for m, x in COHORT_MEASURES.items()])
    out = out.select(key, trunc_wide(F.col("_num_weight_ppm") + F.col("_den_weight_ppm"), F.lit(2)).cast("bigint").alias("ess_milli"), F.inline(rows))
    ratio = F.when(F.col("measure") == "SmartCrowdDivergence", F.col("numerator") - F.col("denominator")).otherwise(trunc_wide(F.col("numerator") * 100_000_000, F.when(F.col("denominator") != 0, F.col("denominator"))))
    return out.select(
        key, "measure", F.col("numerator").cast("bigint").alias("numerator"), F.col("denominator").cast("bigint").alias("denominator"),
        F.when(F.col("denominator") != 0, ratio).cast("bigint").alias("value"), "ess_milli", F.least("ess_milli", F.lit(PPM)).alias("confidence_ppm"),
    )


def break_even_bps(entry, fees, funding) -> Column:
    """Entry plus fees plus funding; an overflow raises."""
    return F.col(entry) + F.col(fees) + F.col(funding)


#: Confidence of each pain state, in ppm (fixed values).
PAIN_CONFIDENCE = {"Unknown": 0, "NearBreakEven": 600_000, "Underwater": 600_000, "Profitable": 750_000, "VoluntaryExit": 750_000, "NearLiquidation": 850_000}


def pain_confidence(state: Column) -> Column:
    """Confidence of a pain state; null for a state that is not one."""
    return F.create_map(*[F.lit(x) for pair in PAIN_CONFIDENCE.items() for x in pair])[state].cast("bigint")


# --- regimes -----------------------------------------------------------------------------------------------------

#: Fixed values.
REGIMES = ["QuietRange", "VolatileRange", "OrderlyUp", "OrderlyDown", "LeveragedUp", "LeveragedDown", "LiquidityStress", "PostLiquidation"]


def regime_weights(vol, trend, oi, liquidity, corr, quiet=400, stress=1800, leverage=800, recovery=500_000) -> Column:
    """The eight integer weights of a market state, 1 where a regime's condition does not hold."""
    conds = [
        ((vol <= quiet) & (F.abs(trend) < 250), 40), ((vol >= stress) & (F.abs(trend) < 400) & (liquidity < 400_000), 35),
        ((trend > 250) & (oi < leverage), 30), ((trend < -250) & (oi < leverage), 30), ((trend > 250) & (oi >= leverage), 35),
        ((trend < -250) & (oi >= leverage), 35), ((liquidity < 250_000) | (corr > 700_000), 45), (liquidity >= recovery, 40),
    ]
    return F.array(*[F.when(c, w).otherwise(1).cast("bigint") for c, w in conds])


def shares_of(weights: list[int]) -> list[int]:
    """``allocate_array`` on plain integers."""
    total = sum(weights)
    parts = [w * PPM // total for w in weights]
    order = sorted(range(len(weights)), key=lambda i: (-(weights[i] * PPM % total), i))
    for i in order[: PPM - sum(parts)]:
        parts[i] += 1
    return parts


def regime_path(states: DataFrame, dwell: int = 300_000_000) -> DataFrame:
    """Regime shares of each key over time: states(key, known, ordinal, weights), an empty array if unsupported.

    Within the dwell of the previous state its dominant regime gains its share plus 200,000, then shares are made
    again.  Unsupported states have equal shares and change 1e6.  One key's states are a fold in order.
    """

    def start() -> dict:
        return {"ppm": None, "known": None}

    def step(s: dict, r: dict) -> list[dict]:
        w = [int(x) for x in r["weights"]]
        supported = bool(w)
        ppm = shares_of(w if supported else [1] * len(REGIMES))
        if supported and s["ppm"] is not None and r["known"] - s["known"] < dwell:
            i = s["ppm"].index(max(s["ppm"]))
            ppm[i] += s["ppm"][i] + 200_000
            ppm = shares_of(ppm)
        top = sorted(ppm, reverse=True)
        s["ppm"], s["known"] = ppm, r["known"]
        dominant = REGIMES[ppm.index(top[0])] if supported else "Unsupported"
        change = PPM - (top[0] - top[1]) if supported else PPM
        return [{"key": r["key"], "ordinal": r["ordinal"], "ppm": ppm, "dominant": dominant, "change": change}]

    from .rolling import fold

    return fold(states, ["key"], ["known", "ordinal"], "key bigint, ordinal bigint, ppm array<bigint>, dominant string, change bigint", start, step)


# --- memory ------------------------------------------------------------------------------------------------------


def contributing_dimensions(a: Column | str, b: Column | str, most: int = 3) -> Column:
    """The 0-based dimensions of the largest squared differences, largest first; ties go to the smaller one."""
    gap = F.zip_with(a, b, lambda x, y: F.abs(x.cast("decimal(38,0)") - y.cast("decimal(38,0)")))
    scored = F.array_sort(F.transform(gap, lambda g, i: F.struct((-g).alias("less"), i.alias("at"))))
    return F.transform(F.slice(scored, 1, most), lambda s: s["at"])


def analogues(memory: DataFrame, queries: DataFrame, k: int, horizon: int, radius: int, block_rows: int = 4096) -> DataFrame:
    """Exact nearest episodes: memory(episode, effective, known, v) against queries(query, q_episode, at, known_at, q).

    Eligible: another episode, known in time and effective before at - horizon.  Order: distance, episode, effective;
    the first row of each episode; the best k.  The queries are a stated set: memory is dealt to blocks of about
    ``block_rows``, each block meets all queries, and only its best k episodes for a query leave it.
    """
    blocks = max(1, -(-memory.count() // block_rows))
    dealt = memory.withColumn("_b", F.pmod(F.xxhash64("episode"), F.lit(blocks)).cast("int"))
    asked = queries.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    ok = (F.col("episode") != F.col("q_episode")) & (F.col("known") <= F.col("known_at")) & (F.col("effective") < F.col("at") - horizon)
    pairs = dealt.join(asked, "_b").where(ok).withColumn("distance", squared_distance("v", "q"))
    first = pairs.groupBy("_b", "query", "episode").agg(F.min(F.struct("distance", "effective", "v", "q")).alias("m")).select("_b", "query", "episode", "m.*")
    local = Window.partitionBy("_b", "query").orderBy("distance", "episode", "effective")
    first = first.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= k).drop("_b", "_r")
    w = Window.partitionBy("query").orderBy("distance", "episode", "effective")
    out = first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.withColumn("support_ppm", F.when(F.min("distance").over(Window.partitionBy("query")) <= radius, 800_000).otherwise(0))


# --- pain, fragility ---------------------------------------------------------------------------------------------


def pain_state(margin_known: Column, distance: Column, pnl: Column, age: Column, near_liq=40, break_even=15, old=3_600_000_000) -> Column:
    """Side does not matter; the first condition that holds decides."""
    return (
        F.when(~margin_known, "Unknown").when(distance <= near_liq, "NearLiquidation").when(F.abs(pnl) <= break_even, "NearBreakEven")
        .when((pnl < 0) & (age >= old), "VoluntaryExit").when(pnl < 0, "Underwater").otherwise("Profitable")
    )


def cascade(rows: list[dict], shock: int, bound: int, depth: int, part: int, stress: int, waves: int = 8, cap: int = 1500) -> dict:
    """Liquidation waves of one market after a price shock (bps); ``bound`` -1, 0, 1 widens or narrows distances.

    Longs lose distance when the price falls.  Each wave liquidates distance <= 0, moves the price by the forced net
    notional against the book, and takes 10 bps from survivors with a collateral group.
    """
    trunc = lambda a, b: abs(a) // b * (1 if a >= 0 else -1)
    live = [dict(r) for r in rows]
    for r in live:
        r["distance"] += (-bound) * r.get("band", 0)
        r["distance"] += shock if r["side"] > 0 else -shock
    moved, forced_all, used, flagged = shock, 0, 0, False
    for i in range(waves):
        out = [r for r in live if r["distance"] <= 0]
        if not out:
            break
        used += 1
        forced = sum(r["notional"] for r in out)
        net = sum(r["side"] * r["notional"] for r in out)
        impact = trunc(abs(net) * part * stress * 10_000, depth * PPM * PPM)
        step = -impact if net >= 0 else impact
        live = [r for r in live if r["distance"] > 0]
        for r in live:
            r["distance"] += (-10 if r.get("collateral") else 0) + (step if r["side"] > 0 else -step)
        moved, forced_all = moved + step, forced_all + forced
        if abs(moved) > cap:
            flagged = True
            break
        if i == waves - 1 and any(r["distance"] <= 0 for r in live):
            flagged = True
    return {
        "cumulative": moved, "waves": used, "forced": forced_all, "absorbed": min(depth, forced_all),
        "vulnerable": sum(r["notional"] for r in live if r["distance"] <= 50), "flagged": flagged,
    }


#: Fixed values.
SHOCKS = (-500, -300, -200, -100, -50, -25, 25, 50, 100, 200, 300, 500)
CASCADE = "market long, shock int, bound int, cumulative long, waves int, forced long, absorbed long, vulnerable long, flagged boolean"


def fragility(accounts: DataFrame, depth: int, part: int, stress: int) -> DataFrame:
    """All shocks and bounds of every market; accounts(market, side, notional, distance, band, collateral).

    A wave only sums notionals, so accounts that are alike in all else are added up first and a market's histogram, not
    its accounts, is walked; each market and shock is a row of its own.
    """
    fields = ["side", "distance", "band", "collateral", "notional"]
    like = [F.col(c).cast("bigint").alias(c) for c in ("side", "distance", "band")] + [(F.coalesce("collateral", F.lit(0)) != 0).cast("bigint").alias("collateral")]
    alike = accounts.groupBy("market", *like).agg(F.sum(F.col("notional").cast("bigint")).alias("notional"))
    rows = alike.groupBy("market").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("held"))
    rows = rows.withColumn("shock", F.explode(F.array(*map(F.lit, SHOCKS)))).repartition("market", "shock")

    def run(pdfs):
        import pandas as pd

        for pdf in pdfs:
            out = []
            for key, shock, held in zip(pdf["market"], pdf["shock"], pdf["held"]):
                own = [{c: int(r[c]) for c in fields} for r in held]
                out += [{"market": key, "shock": shock, "bound": bound, **cascade(own, int(shock), bound, depth, part, stress)} for bound in (-1, 0, 1)]
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in CASCADE.split(", ")])

    return rows.mapInPandas(run, CASCADE)
