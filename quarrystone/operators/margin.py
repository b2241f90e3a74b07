"""Margin models over positions: cross, isolated, unified, portfolio, builder markets, outcomes.

Positions: account, market, quantity, oracle, initial_bps, maintenance_bps, collateral (equal in an account's rows).
Requirements must be exact; a requirement that is not divisible is withheld with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import trunc_div


def requirements(positions: DataFrame, unit: int = 10_000) -> DataFrame:
    """Adds initial and maintenance; zero quantities are left out; inexact products are null."""
    live = positions.where("quantity <> 0").withColumn("notional", F.abs("quantity") * F.col("oracle"))

    def need(rate: str) -> Column:
        raw = F.col("notional") * F.col(rate)
        return F.when(raw % unit == 0, trunc_div(raw, F.lit(unit)))

    return live.withColumn("initial", need("initial_bps")).withColumn("maintenance", need("maintenance_bps"))


def _total(c: str, cond: Column | None = None) -> Column:
    x = F.col(c) if cond is None else F.when(cond, F.col(c))
    return F.coalesce(F.sum(x), F.lit(0).cast("bigint"))


def assess(positions: DataFrame, model: str, market: str | None = None) -> DataFrame:
    """One row an account: positions, initial, maintenance, ratio_e8, price kind and its range, inexact count."""
    r = requirements(positions)
    if model in ("isolated", "outcome"):
        r = r.where(F.col("market") == market)
    long = F.col("quantity") > 0
    maintenance = F.greatest(_total("maintenance", long), _total("maintenance", ~long)) if model == "unified" else _total("maintenance")
    t = r.groupBy("account").agg(
        F.count(F.lit(1)).alias("positions"), _total("initial").alias("initial"), maintenance.alias("maintenance"), F.first("collateral").alias("collateral"),
        F.count(F.when(F.col("maintenance").isNull() | F.col("initial").isNull(), 1)).alias("inexact"), F.min("oracle").alias("low"), F.max("oracle").alias("high"),
    )
    exact = (F.col("positions") == 1) & (F.col("maintenance") > 0) & (F.col("collateral") * F.col("low") % F.col("maintenance") == 0)
    kind = F.lit("NotApplicable") if model == "outcome" else F.lit("Range") if model == "portfolio" else F.when(F.col("maintenance") == 0, "NotApplicable").when(exact, "Exact").otherwise("Range")
    price = F.when(kind == "Exact", F.expr("collateral * low div maintenance"))
    ratio = F.when(F.col("maintenance") == 0, F.lit(0).cast("bigint")).when(F.col("collateral") * 100_000_000 % F.col("maintenance") == 0, F.expr("collateral * 100000000 div maintenance"))
    bad = F.when(F.col("inexact") > 0, "inexact").when((F.lit(model) == "isolated") & (F.col("positions") != 1), "isolated needs one position")
    return t.select("account", "positions", "initial", "maintenance", ratio.alias("ratio_e8"), kind.alias("kind"), F.coalesce(price, "low").alias("low"), F.coalesce(price, "high").alias("high"), bad.alias("error"))
