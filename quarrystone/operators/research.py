"""Walk-forward research: folds, leakage guards, metrics, block bootstrap, registries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import PPM, trunc_div, trunc_wide, wide
from .simulation import splitmix64, trunc

#: Fixed values.
MODEL_EDGES = (
    ("none", "Registered"), ("Registered", "Validated"), ("Validated", "Shadow"), ("Shadow", "Live"), ("Live", "Retired"), ("Registered", "Rejected"),
    ("Validated", "Rejected"), ("Shadow", "Rejected"),
)


def folds(training: tuple[int, int], validation: list[tuple[int, int]], horizon: int, embargo: int) -> list[dict]:
    """Expanding folds: each trains from the start to the end of the previous validation range."""
    out, end = [], training[1]
    for v in sorted(validation):
        out.append({"training_from": training[0], "training_to": end, "validation_from": v[0], "validation_to": v[1], "purge": horizon, "embargo": embargo})
        end = v[1]
    return out


def leakage(train: DataFrame, fold: dict) -> DataFrame:
    """Training rows whose label reaches into the validation range: must be empty."""
    return train.where((F.col("label_start") <= fold["validation_to"]) & (F.col("label_end") >= fold["validation_from"]))


def bootstrap(outcomes: list[int], block: int = 2, replicates: int = 200, seed: int = 7) -> tuple[str, int | None, int | None]:
    """Block bootstrap of the mean: fewer than 8 withheld, fewer than 30 the mean alone, else its 5 % quantile too."""
    n = len(outcomes)
    if n < 8:
        return "Withheld", None, None
    mean = trunc(sum(outcomes), n)
    if n < 30:
        return "MeanOnly", mean, None
    means, state = [], seed
    for _ in range(replicates):
        drawn: list[int] = []
        while len(drawn) < n:
            state = splitmix64(state)
            at = state % n
            drawn += [outcomes[(at + j) % n] for j in range(block)]
        means.append(trunc(sum(drawn[:n]), n))
    return "Full", mean, sorted(means)[replicates * 5 // 100]


def bootstraps(series: DataFrame, key: str = "key", values: str = "outcomes") -> DataFrame:
    """(key, status, mean, lower) for each row's array of outcomes."""
    schema = f"{key} {series.schema[key].dataType.simpleString()}, status string, mean bigint, lower bigint"

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            got = [bootstrap([int(v) for v in vs]) for vs in pdf[values]]
            yield pd.DataFrame({key: pdf[key], "status": [g[0] for g in got], "mean": pd.array([g[1] for g in got], "Int64"), "lower": pd.array([g[2] for g in got], "Int64")})

    return series.select(key, values).mapInPandas(run, schema)


def hit(prediction: Column, outcome: Column) -> Column:
    """Same sign; both zero counts."""
    return F.signum(prediction) == F.signum(outcome)


def episode_shares(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    total = F.sum(F.abs(F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn("share_ppm", F.when(total != 0, trunc_div(F.abs(F.col(value)) * PPM, total)))


def promotion(evidence: DataFrame) -> DataFrame:
    """The twelve gates (gate, decision, reason) over (outcomes, days, largest_share_ppm, as_probability, shadow_live, locked).

    No gate ever passes here: what is known to be short fails, the rest is withheld with its reason, so ``promoted``
    is false.  Null days or shares are unmodelled.
    """
    c = F.col

    def gate(name: str, reason: Column | str, failed: Column | None = None) -> Column:
        decision = F.lit("Withheld") if failed is None else F.when(F.coalesce(failed, F.lit(False)), "Fail").otherwise("Withheld")
        return F.struct(F.lit(name).alias("gate"), decision.alias("decision"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))

    def by(failed: Column, why: str, otherwise: str, unknown: Column | None = None, unmodelled: str = "") -> Column:
        out = F.when(F.coalesce(failed, F.lit(False)), why).otherwise(otherwise)
        return out if unknown is None else F.when(unknown, unmodelled).otherwise(out)

    few, short, heavy = c("outcomes") < 100, c("days") < 90, c("largest_share_ppm") > 200_000
    gates = [
        gate("independent_outcomes", by(few, "insufficient_independent_outcomes", "no_locked_holdout"), few),
        gate("calendar_coverage", by(short, "insufficient_calendar_coverage", "no_locked_holdout", c("days").isNull(), "calendar_unmodeled"), short),
        gate("net_expectancy_bootstrap", "significance_not_claimed"), gate("cost_stress", "cost_stress_unmodeled"), gate("latency_stress", "latency_stress_unmodeled"),
        gate("concentration", by(heavy, "episode_share_exceeds_policy", "no_locked_holdout", c("largest_share_ppm").isNull(), "episode_shares_unmodeled"), heavy),
        gate("drawdown", "no_preregistered_holdout_budget"),
        gate("calibration", by(c("as_probability"), "probability_display_forbidden", "uncalibrated"), c("as_probability")),
        gate("capacity", "synthetic_linear_only"), gate("shadow_live", by(c("shadow_live"), "shadow_live_not_production", "shadow_live_not_implemented"), c("shadow_live")),
        gate("reproducibility", "two_builder_reproduction_unmodeled"), gate("locked_holdout", by(c("locked"), "holdout_pass_not_implemented", "no_locked_holdout"), c("locked")),
    ]
    return evidence.withColumn("gates", F.array(*gates)).withColumn("promoted", F.lit(False))


def baselines(train: DataFrame, key: str, order: list[str], feature: str, outcome: str) -> DataFrame:
    """(key, class, intercept, weight) of the baseline estimators, raw values at scale 8: the mean outcome, no trade,
    momentum (the last outcome), mean reversion (the mean less the feature) and the raw feature."""
    one = 100_000_000
    fit = train.groupBy(key).agg(F.sum(wide(outcome)).alias("_sum"), F.count(outcome).alias("_n"), F.max(F.struct(*order, F.col(outcome).alias("_y")))["_y"].alias("last"))
    fit = fit.withColumn("mean", trunc_wide(F.col("_sum"), F.col("_n")).cast("bigint"))
    rows = [("MeanOutcome", F.col("mean"), 0), ("NoTrade", F.lit(0), 0), ("Momentum", F.col("last"), 0), ("MeanReversion", F.col("mean"), -one), ("RawFeature", F.lit(0), one)]
    made = [F.struct(F.lit(n).alias("class"), i.cast("bigint").alias("intercept"), F.lit(w).cast("bigint").alias("weight")) for n, i, w in rows]
    return fit.select(key, F.inline(F.array(*made)))


def multiple_testing(variants: DataFrame, family: str) -> DataFrame:
    """(family, attempted_variants, bonferroni_divisor, withheld_reason): every attempt counts; nothing is claimed."""
    n = variants.groupBy(family).agg(F.count("variant").alias("attempted_variants"))
    reason = F.when(F.col("attempted_variants") == 0, "empty_family").otherwise("no_locked_holdout")
    return n.select(family, "attempted_variants", F.greatest("attempted_variants", F.lit(1).cast("bigint")).alias("bonferroni_divisor"), reason.alias("withheld_reason"))


def shortfalls(outcomes: DataFrame, key: str, outcome: str, least: int = 20) -> DataFrame:
    """(key, n, es): mean, toward zero, of the floor(5 %) worst outcomes, one at least; withheld below ``least``."""
    w = Window.partitionBy(key).orderBy(outcome)
    n = outcomes.groupBy(F.col(key).alias("_k")).agg(F.count(outcome).alias("n"))
    ranked = outcomes.withColumn("_r", F.row_number().over(w)).join(n, F.col(key) == F.col("_k"))
    worst = F.when((F.col("n") >= least) & (F.col("_r") <= F.greatest(trunc_div(F.col("n") * 5, F.lit(100)), F.lit(1))), wide(outcome))
    return ranked.groupBy(key, "n").agg(trunc_wide(F.sum(worst), F.count(worst)).cast("bigint").alias("es"))


def registered(rows: DataFrame, key: str = "experiment_id") -> DataFrame:
    """The rows, if every key is new; an error otherwise."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return rows.withColumn(key, F.when(n == 1, F.col(key)).otherwise(F.raise_error(F.lit("registered twice"))))


def subscriptions(wanted: list[tuple[str, int]], connections: int = 10, subscriptions_: int = 1000, messages: int = 2000) -> dict:
    """First-fit plan of (name, messages a minute) under the venue's limits; what does not fit is refused, in order."""
    load = [[0, 0] for _ in range(connections)]
    plan, refused = {}, []
    for name, rate in sorted(wanted, key=lambda x: (-x[1], x[0])):
        for i, (count, used) in enumerate(load):
            if count < subscriptions_ // connections and used + rate <= messages // connections:
                load[i] = [count + 1, used + rate]
                plan[name] = i
                break
        else:
            refused.append(name)
    return {"plan": plan, "refused": refused}
