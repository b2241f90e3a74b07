"""Wallet intelligence: performance, concentration, skill, style, intent, copyability."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from math import isqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import PPM, isqrt as isqrt_col
from ..functions.fixed import logistic_ppm, trunc_div, trunc_wide, wide


def shares(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """hhi_ppm and best_ppm of |value| shares, each truncated; keys whose total is zero are withheld (null)."""
    total = F.sum(F.abs(F.col(value))).over(Window.partitionBy(*keys))
    s = F.when(total != 0, trunc_wide(wide(F.abs(F.col(value))) * PPM, total).cast("bigint"))
    out = df.withColumn("_s", s).groupBy(*keys).agg(F.sum(trunc_div(F.col("_s") * F.col("_s"), F.lit(PPM))).alias("hhi_ppm"), F.max("_s").alias("best_ppm"))
    return out


def ratio_ppm(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, trunc_wide(wide(part) * PPM, whole).cast("bigint"))


PERFORMANCE = "subject long, twr_e12 decimal(38,0), mwr_e12 decimal(38,0), gain long, max_drawdown_e12 decimal(38,0), recovery long, expected_shortfall_e12 decimal(38,0), downside_e12 decimal(38,0), observations long"


def _even(f: Fraction, scale: int) -> int:
    n = f * 10**scale
    q, r = divmod(n.numerator, n.denominator)
    twice = 2 * r
    return q + (twice > n.denominator or (twice == n.denominator and q % 2))


def _trunc(a: int, b: int) -> int:
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


def performance(rows: DataFrame) -> DataFrame:
    """Performance of each subject from (subject, time, kind, ordinal, amount): kind 0 observes equity, 1 is a flow.

    Wealth is an exact rational chained at each flow, so the time-weighted return has one rounding; peaks and drawdowns
    compare wealth at scale 12.  Recovery counts from the time of the peak before, the first observation included.  A subject whose
    first row is a flow, or whose equity is not positive before a flow, is withheld (nulls).
    """

    series = rows.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("time", "kind", "ordinal", "amount"))).alias("series"))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in PERFORMANCE.split(", ")]
        for pdf in pdfs:
            made = [_performance(int(k), [(int(r["time"]), int(r["kind"]), int(r["amount"])) for r in s]) for k, s in zip(pdf["subject"], pdf["series"])]
            yield pd.DataFrame(made, columns=names).astype(object)

    return series.mapInPandas(run, PERFORMANCE)


def _performance(subject: int, events: list[tuple[int, int, int]]) -> dict:
    """One subject's row from its ordered (time, kind, amount)."""
    out = dict.fromkeys(c.split(" ")[0] for c in PERFORMANCE.split(", ")) | {"subject": subject, "observations": sum(k == 0 for _, k, _ in events)}
    if not events or events[0][1] == 1 or events[0][2] <= 0:
        return out
    start = equity = events[0][2]
    began, last = events[0][0], events[-1][0]
    span = max(last - began, 1)
    wealth, base, flows, weighted = Fraction(1), equity, 0, 0
    # the first observation is no new peak, so the series starts in a drawdown of zero
    peak, peak_at, drawdown, recovery, under = Fraction(1), began, Fraction(0), None, True
    returns, previous = [], equity
    for time, kind, amount in events[1:]:
        if kind == 1:
            if equity <= 0:
                return out
            wealth *= Fraction(equity, base)
            equity += amount
            flows += amount
            weighted += _trunc(amount * (last - time), span)
            base = previous = equity
            if base <= 0:
                return out
            continue
        if previous != 0:
            returns.append(_even(Fraction(amount, previous) - 1, 12))
        equity = previous = amount
        now = Fraction(_even(wealth * Fraction(equity, base), 12), 10**12)
        if now > peak:
            if under:
                recovery, under = time - peak_at, False
            peak, peak_at = now, time
        else:
            under = True
            drawdown = max(drawdown, Fraction(_even((peak - now) / peak, 12), 10**12)) if peak else drawdown
    gain, money = equity - start - flows, start + weighted
    worst = sorted(returns)[: -(-len(returns) // 20)]
    negative = [r for r in returns if r < 0]
    return out | {
        "twr_e12": Decimal(_even(wealth * Fraction(equity, base) - 1, 12)), "mwr_e12": Decimal(_even(Fraction(gain, money), 12)) if money > 0 else None,
        "gain": gain, "max_drawdown_e12": Decimal(_even(drawdown, 12)), "recovery": recovery,
        "expected_shortfall_e12": Decimal(_even(Fraction(sum(worst), len(worst)), 0)) if len(returns) >= 5 else None,
        "downside_e12": Decimal(isqrt(sum(r * r for r in negative) // len(negative)) if negative else 0) if returns else None,
    }


def skill_posterior(n: Column, total: Column, square_dev: Column, ess: Column, mu: int = 0, kappa: int = 10_000) -> dict[str, Column]:
    """Shrunk mean, standard error and logistic probability of a skill, in integers."""
    mean = trunc_div(total, n)
    post = trunc_div(F.lit(kappa * mu) + ess * mean, ess + kappa)
    std = isqrt_col(F.greatest(F.lit(1), trunc_div(square_dev, n)))
    se = trunc_div(std * 1000, F.greatest(F.lit(1), isqrt_col(ess)))
    z = F.when(se == 0, F.when(post >= 0, 8000).otherwise(-8000)).otherwise(trunc_div(post * 1000, F.greatest(se, F.lit(1))))
    return {"mean": mean, "posterior": post, "se": se, "z_milli": z.cast("bigint"), "probability_ppm": logistic_ppm(z)}


#: Classes in their order (fixed values).
STYLES = [
    "DirectionalDiscretionary", "MomentumTrend", "MeanReversion", "Scalping", "SwingTrading", "MarketMaking", "BasisSpotPerpArbitrage",
    "FundingCarryCapture", "LiquidationTrading", "PortfolioHedge", "VaultStrategy", "AutomatedFollower", "UnclassifiedMixed",
]
#: Classes in their order (fixed values).
INTENTS = [
    "OpenDirectional", "AddDirectional", "ReduceRisk", "CloseDirectional", "HedgeExistingExposure", "CarryOrBasis", "MarketMakerInventory",
    "LiquidationOrForced", "TransferOrAccountRebalance", "Unknown",
]


def _weights(classes: list[str], base: dict[str, Column], additions: list[tuple[str, Column, int]]) -> Column:
    """An array of integer weights by class: 1, or the class's base, plus its additions whose condition holds."""
    out = {c: base.get(c, F.lit(1)).cast("bigint") for c in classes}
    for name, cond, add in additions:
        out[name] = out[name] + F.when(cond, add).otherwise(0)
    return F.array(*out.values())


def style_weights(maker, turnover, hold, reversion, beta, funding, basis, sync, lag, liquidation, vault) -> Column:
    """Integer weights of STYLES; a missing feature adds nothing, a missing maker or turnover makes UnclassifiedMixed 80."""
    missing = maker.isNull() | turnover.isNull()
    additions = [
        ("MarketMaking", maker >= 700_000, 40), ("Scalping", turnover >= 800_000, 30), ("SwingTrading", turnover <= 150_000, 25),
        ("Scalping", hold <= 5_000_000, 20), ("SwingTrading", hold >= 3_600_000_000, 20), ("MarketMaking", reversion >= 700_000, 25),
        ("MeanReversion", reversion >= 700_000, 10), ("DirectionalDiscretionary", F.abs(beta) >= 800, 25), ("MomentumTrend", F.abs(beta) >= 800, 15),
        ("FundingCarryCapture", funding >= 700_000, 35), ("BasisSpotPerpArbitrage", basis >= 700_000, 35),
        ("AutomatedFollower", (sync >= 700_000) & (lag <= 2_000_000), 40), ("LiquidationTrading", liquidation, 50), ("VaultStrategy", vault, 50),
    ]
    return _weights(STYLES, {"UnclassifiedMixed": F.when(missing, 80).otherwise(1)}, additions)


def intent_weights(flat, increased, decreased, leverage_decreased, maker, carry, liquidation, transfer, hedge) -> Column:
    """Integer weights of INTENTS.  What the size did counts once, by the first case that fits; Unknown is 70 where
    neither the position before nor an increase is known."""
    case = (
        F.when(flat & increased, "OpenDirectional").when(~flat & increased, "AddDirectional")
        .when(decreased & leverage_decreased, "ReduceRisk").when(~flat & decreased, "CloseDirectional")
    )
    additions = [("OpenDirectional", case == "OpenDirectional", 40), ("AddDirectional", case == "AddDirectional", 40), ("ReduceRisk", case == "ReduceRisk", 40)]
    additions += [("CloseDirectional", case == "CloseDirectional", 30), ("HedgeExistingExposure", hedge, 35), ("CarryOrBasis", carry, 35)]
    additions += [("MarketMakerInventory", maker, 35), ("LiquidationOrForced", liquidation, 50), ("TransferOrAccountRebalance", transfer, 50)]
    return _weights(INTENTS, {"Unknown": F.when(flat.isNull() & increased.isNull(), 70).otherwise(1)}, additions)


def copyability(p10: Column, p50: Column, p90: Column, bankroll: Column, depth: Column, fee: Column, coef: Column, part: Column, threshold: Column) -> dict[str, Column]:
    """Impact, fill probability, capacity and class of copying at a size."""
    size = F.least(trunc_wide(wide(bankroll) * PPM, depth).cast("bigint"), part)
    impact = trunc_div(coef * size, F.lit(PPM))
    net = p50 - fee - impact
    used = trunc_wide(wide(trunc_wide(wide(bankroll) * wide(part), F.lit(PPM))) * PPM, depth).cast("bigint")
    fill = F.greatest(F.lit(0), F.lit(PPM) - F.least(F.lit(PPM), used))
    share = F.least(F.greatest(trunc_div(threshold * PPM, coef), F.lit(0)), F.lit(PPM))
    capacity = trunc_wide(wide(depth) * wide(share), F.lit(PPM)).cast("bigint")
    kind = (
        F.when((net <= 0) | (p90 <= 0), "NotCopyable").when((impact >= threshold) | (fill < 250_000), "CapacityLimited")
        .when((p10 <= 0) | (p90 - p10 >= F.greatest(net, F.lit(1)) * 2), "LatencySensitive").otherwise("Actionable")
    )
    return {"impact": impact, "net_bps": net, "fill_ppm": fill, "capacity": capacity, "stressed": trunc_div(capacity, F.lit(2)), "class": kind}
