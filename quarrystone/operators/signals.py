"""Signals: reasons of the three families, utility, invalidation, alert policy, dedup, promotion gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fixed import PPM, trunc_wide, wide


def reasons(*named: tuple[str, Column]) -> Column:
    """Names of the conditions that hold, in order: empty means admitted."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in named]), lambda x: x.isNotNull())


def acceleration(votes, accel, markout, capacity, crowding, cost, followers, least_votes=3, least_accel=100, least_markout=20, most_crowding=600_000) -> Column:
    return reasons(
        ("votes", votes < least_votes), ("acceleration", accel < least_accel), ("markout", markout < least_markout), ("capacity", capacity <= 0),
        ("crowding", crowding > most_crowding), ("cost", cost >= F.greatest(F.lit(least_markout), F.lit(0))), ("followers", followers),
    )


def divergence(votes, smart, crowd, explained, followers, least_votes=3, least=1000) -> Column:
    return reasons(
        ("votes", votes < least_votes), ("sign", F.signum(smart) * F.signum(crowd) >= 0), ("size", (F.abs(smart) < least) | (F.abs(crowd) < least)),
        ("explained", explained), ("followers", followers),
    )


def asymmetry(low, base, high, absorbed, forced, waves, least=25) -> Column:
    return reasons(("flat", F.abs(base - F.greatest(high, low)) < least), ("absorbed", absorbed >= forced), ("waves", waves == 0))


def utility(net, confidence, capacity_ok, fresh, crowding, tail, uncertainty) -> Column:
    gain = trunc_wide(trunc_wide(wide(net) * wide(confidence) * F.when(capacity_ok, PPM).otherwise(0), F.lit(PPM)) * wide(fresh), F.lit(PPM)).cast("bigint")
    return gain - crowding - F.abs(tail) * 1000 - uncertainty


def alert(state: Column, material: Column, elapsed: Column, emitted: Column, risk: Column, cooldown: int, budget: int) -> Column:
    return (
        F.when(state.isin("Invalidated", "Expired") | risk, "AlwaysEmit").when(~material & F.coalesce(elapsed < cooldown, F.lit(False)), "Cooldown")
        .when(~material & (emitted >= budget), "Budget").otherwise("Emit")
    )


def invalidated(
    kind: Column, closed_ppm: Column, flow: Column, independence_ppm: Column, cost_exceeds_edge: Column, data_health: Column, book_health: Column, now: Column,
    threshold: Column,
) -> Column:
    """(triggered, distance_ppm) of a rule by its kind; an unknown kind is null (withheld), never false.

    A missing flow triggers FlowBelow.  The distance is what is left to the threshold, 0 for rules without one; a
    custom approved rule never triggers by itself and is 1e6 away.
    """

    def status(triggered: Column, left: Column | int = 0) -> Column:
        left = F.lit(left) if isinstance(left, int) else left
        return F.struct(triggered.alias("triggered"), F.least(F.greatest(left, F.lit(0)), F.lit(1_000_000)).cast("bigint").alias("distance_ppm"))

    return (
        F.when(kind == "OriginatorExposureClosed", status(closed_ppm >= threshold, threshold - closed_ppm))
        .when(kind == "FlowBelow", status(F.coalesce(flow < threshold, F.lit(True))))
        .when(kind == "IndependenceBelow", status(independence_ppm < threshold, independence_ppm - threshold))
        .when(kind == "CostAboveEdge", status(cost_exceeds_edge)).when(kind == "DataHealthNotGreen", status(data_health != "Green"))
        .when(kind == "BookHealthNotGreen", status(book_health != "Green")).when(kind == "TimeExpired", status(now >= threshold))
        .when(kind == "CustomApproved", status(F.lit(False), 1_000_000))
    )


def gates(*named: tuple[str, Column]) -> Column:
    """(name, passed) of each promotion gate; a missing input fails its gate."""
    return F.array(*[F.struct(F.lit(n).alias("gate"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in named])


def dedup_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
