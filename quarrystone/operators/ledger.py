"""Ledger folds: orders, positions and episodes, account flows, staking, lifecycle chains, block validity.

What can be said with a running sum or a neighbour is a window over the key; rows that break a rule are kept and
named in ``error`` (``checked`` turns them into a raised error).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rolling import fold

#: Fixed values.
ORDER_EDGES = (
    ("none", "Accepted"), ("Accepted", "Rested"), ("Modified", "Rested"), ("Accepted", "Modified"), ("Rested", "Modified"), ("Modified", "Modified"),
    ("PartiallyFilled", "Modified"), ("Accepted", "PartiallyFilled"), ("Rested", "PartiallyFilled"), ("Modified", "PartiallyFilled"),
    ("PartiallyFilled", "PartiallyFilled"), ("Accepted", "Filled"), ("Rested", "Filled"), ("Modified", "Filled"), ("PartiallyFilled", "Filled"),
    ("Accepted", "Cancelled"), ("Rested", "Cancelled"), ("Modified", "Cancelled"), ("PartiallyFilled", "Cancelled"),
)
#: Fixed values.
SIGNAL_EDGES = (
    ("none", "Candidate"), ("Candidate", "Validated"), ("Candidate", "Invalidated"), ("Candidate", "Expired"), ("Validated", "Live"),
    ("Validated", "Invalidated"), ("Validated", "Expired"), ("Live", "Decaying"), ("Live", "Invalidated"), ("Live", "Expired"),
    ("Decaying", "Invalidated"), ("Decaying", "Expired"), ("Decaying", "Resolved"), ("Invalidated", "Resolved"), ("Expired", "Resolved"),
)


def checked(df: DataFrame, error: str = "error") -> DataFrame:
    """Raise on the first row with an error.  The check sits in a kept column, so it cannot be pruned away."""
    return df.withColumn(error, F.when(F.col(error).isNotNull(), F.raise_error(F.col(error))).cast("string"))


def legal(edges: tuple[tuple[str, str], ...], before: Column, after: Column) -> Column:
    return F.array_contains(F.array(*[F.lit(f"{a}>{b}") for a, b in edges]), F.concat(F.coalesce(before, F.lit("none")), F.lit(">"), after))


def transitions(df: DataFrame, keys: list[str], order: list[str], state: str, edges: tuple[tuple[str, str], ...]) -> DataFrame:
    """Each row's previous state and whether the move is legal."""
    before = F.lag(state).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("previous", before).withColumn("legal", legal(edges, F.col("previous"), F.col(state)))


def order_fills(fills: DataFrame, accepted: DataFrame, order_id: str, order: list[str], qty: str, limit: str) -> DataFrame:
    """Running fill of each order against its accepted quantity: filled, remaining, error."""
    w = Window.partitionBy(order_id).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = fills.join(accepted, order_id, "left").withColumn("filled", F.sum(qty).over(w))
    error = F.when(F.col(limit).isNull(), "unknown order").when(F.col("filled") > F.col(limit), "overfill").when(F.col(qty) <= 0, "non-positive fill")
    return out.withColumn("remaining", F.col(limit) - F.col("filled")).withColumn("error", error)


def episodes(trades: DataFrame, keys: list[str], order: list[str], signed: str) -> DataFrame:
    """Position episodes from signed fills: one or two legs a fill.

    ``start`` and ``result`` are the position around the fill.  A sign flip closes |start| and opens the rest as a
    second leg of a new episode.  Episodes are numbered per key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    run = trades.withColumn("result", F.sum(signed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("start", F.col("result") - F.col(signed))
    flip = (F.signum("start") * F.signum("result")) < 0
    opens = ((F.col("start") == 0) & (F.col("result") != 0)) | flip
    run = run.withColumn("_n", F.sum(F.when(opens, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    leg = lambda ordinal, n, qty, kind: F.struct(F.lit(ordinal).alias("leg"), n.alias("episode"), qty.alias("leg_qty"), kind.alias("reason"))
    n = F.col("_n").cast("bigint")
    closing = F.when(F.col("result") == 0, "TradeFlat").when(F.col("start") == 0, "Open").otherwise("Update")
    legs = F.when(flip, F.array(leg(0, n - 1, -F.col("start"), F.lit("TradeReversal")), leg(1, n, F.col("result"), F.lit("Open")))).otherwise(
        F.array(leg(0, n, F.col(signed), closing))
    )
    return run.withColumn("_l", F.explode(legs)).select("*", "_l.*").drop("_l", "_n")


def signed_legs(events: DataFrame, rules: dict[str, list[tuple[str, str, int]]], kind: str, amount: str) -> DataFrame:
    """Each event as its signed legs (account, scope, delta); ``rules``: kind -> (account column, scope, sign)."""
    legs = None
    for name, parts in rules.items():
        made = F.array(*[F.struct(F.col(a).alias("account"), F.lit(scope).alias("scope"), (F.col(amount) * sign).alias("delta")) for a, scope, sign in parts])
        legs = F.when(F.col(kind) == name, made) if legs is None else legs.when(F.col(kind) == name, made)
    return events.withColumn("_l", F.explode(legs)).select(*events.columns, "_l.account", "_l.scope", "_l.delta")


def balances(legs: DataFrame) -> DataFrame:
    """Credits, debits and net of each account and scope; partial sums before the shuffle."""
    up, down = F.when(F.col("delta") > 0, F.col("delta")).otherwise(0), F.when(F.col("delta") < 0, -F.col("delta")).otherwise(0)
    return legs.groupBy("account", "scope").agg(F.sum(up).alias("credit"), F.sum(down).alias("debit"), F.sum("delta").alias("net"))


def block_errors(events: DataFrame) -> DataFrame:
    """Rule breaks of events(block, tx, tx_id, idx): indices start at 0 and are contiguous, one identity a transaction."""
    w = Window.partitionBy("block", "tx").orderBy("idx")
    rows = events.withColumn("_i", F.row_number().over(w) - 1)
    return rows.groupBy("block").agg(
        F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("_i") != F.col("idx"), 1)).alias("bad_index"), F.countDistinct("tx").alias("transactions")
    )


def depth_walk(levels: DataFrame, keys: list[str], order: list[Column], qty: str, wanted: Column) -> DataFrame:
    """Quantity taken from each level, best first, until ``wanted`` is filled."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(qty).over(w), F.lit(0))
    return levels.withColumn("take", F.least(F.greatest(wanted - before, F.lit(0)), F.col(qty)))


def margin(positions: DataFrame, keys: list[str], notional: str, long: str, rate_bps: str, collateral: str) -> DataFrame:
    """Maintenance by model: cross (sum), unified (larger of long and short); liquidation price only where exact."""
    need = F.expr(f"{notional} * {rate_bps} div 10000")
    t = positions.withColumn("_m", need).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("positions"), F.sum("_m").alias("cross"), F.greatest(F.coalesce(F.sum(F.when(F.col(long), F.col("_m"))), F.lit(0)), F.coalesce(F.sum(F.when(~F.col(long), F.col("_m"))), F.lit(0))).alias("unified"), F.sum(collateral).alias("collateral")
    )
    return t.withColumn("state", F.when(F.col("cross") == 0, "Safe").when(F.col("collateral") < F.col("cross"), "Below").otherwise("Above"))


NONTRADE = "key bigint, ordinal bigint, quantity bigint, state string, close_cause string, error string"


class Position:
    """A position that liquidation fills, backstops and settlements move toward zero.

    ``quantity`` is None once it cannot be known: after a backstop, after a settlement beyond the position or on no
    position.  Nothing makes an unknown position known again but an anchor.  A refused event changes nothing.
    """

    def __init__(self, quantity: int | None = 0) -> None:
        self.quantity = quantity
        self.facts: set[int] = set()

    def apply(self, kind: str, amount: int, fact: int) -> tuple[str | None, str | None]:
        """(close cause, error) of one event: Anchor, Trade, LiquidationFill, BackstopLiquidation or PositionSettled."""
        if fact in self.facts:
            return None, "identity_collision"
        q = self.quantity
        if kind == "Anchor":
            self.quantity = amount
        elif kind == "Trade":
            self.quantity = None if q is None else q + amount
        elif kind == "BackstopLiquidation":
            self.quantity = None
        elif q == 0 and kind == "LiquidationFill":
            return None, "fill_overrun"
        elif not q or abs(q) < amount:
            if q and kind == "LiquidationFill":
                return None, "fill_overrun"
            self.quantity = None
        else:
            self.quantity = q - amount if q > 0 else q + amount
        self.facts.add(fact)
        if kind == "BackstopLiquidation" and q != 0:
            return "BackstopInterrupted", None
        if kind in ("LiquidationFill", "PositionSettled") and q and self.quantity == 0:
            return "Liquidation" if kind == "LiquidationFill" else "Settlement", None
        return None, None


def nontrade_positions(events: DataFrame) -> DataFrame:
    """Quantity, state and close cause of a position after each of events(key, us, ordinal, kind, amount, fact).

    A key's events are a fold in the order of (us, ordinal): each quantity depends on the sign before it.
    """

    def step(s: dict, r: dict) -> list[dict]:
        cause, error = s["p"].apply(r["kind"], int(r["amount"]), int(r["fact"]))
        q = s["p"].quantity
        state = "Ambiguous" if q is None else "Flat" if q == 0 else "Open"
        return [{"key": r["key"], "ordinal": r["ordinal"], "quantity": q, "state": state, "close_cause": cause, "error": error}]

    return fold(events, ["key"], ["us", "ordinal"], NONTRADE, lambda: {"p": Position()}, step)
