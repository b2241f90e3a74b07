"""Row operators over the node's record files: order statuses, book diffs, action blocks, misc events, order snapshots.

Every parser takes lines(value) and gives one row per event, with its place in its record.  A record of another shape
raises; nothing is dropped or guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import parse_at_scale
from .parsers import RECORDS, STRICT

#: Action types of signed actions (fixed values).
ACTION_TYPES = (
    "order cancel cancelByCloid scheduleCancel modify batchModify updateLeverage topUpIsolatedOnlyMargin updateIsolatedMargin sendAsset agentSendAsset"
    " sendToEvmWithData usdSend spotSend withdraw3 usdClassTransfer cDeposit cWithdraw tokenDelegate vaultTransfer hip3LiquidatorTransfer approveAgent"
    " approveBuilderFee twapOrder twapCancel reserveRequestWeight noop userDexAbstraction agentEnableDexAbstraction userSetAbstraction"
    " agentSetAbstraction userOutcome validatorL1Stream authorizeAqav2Role claimRewards"
).split()
#: Variants of misc events and the fields that each must have (fixed values).
MISC_FIELDS = {
    "CDeposit": "user amount", "Delegation": "user validator amount is_undelegate", "CWithdrawal": "user amount is_finalized", "ValidatorRewards": "validator_to_reward",
    "Funding": "coin usdc szi fundingRate nSamples", "LedgerUpdate": "users delta",
}
#: Variants of ledger deltas and the fields that each must have (fixed values).
DELTA_FIELDS = {
    "Withdraw": "usdc nonce fee", "Deposit": "usdc", "VaultCreate": "vault usdc fee", "VaultDeposit": "", "VaultWithdraw": "vault user requestedUsd commission closingCost basis",
    "VaultDistribution": "vault usdc", "VaultLeaderCommission": "", "Liquidation": "liquidatedNtlPos accountValue leverageType liquidatedPositions",
    "InternalTransfer": "usdc user destination fee", "AccountClassTransfer": "usdc toPerp", "SubAccountTransfer": "usdc user destination",
    "SpotTransfer": "token amount usdcValue user destination fee nativeTokenFee", "SpotGenesis": "token amount", "RewardsClaim": "amount",
    "AccountActivationGas": "amount token", "PerpDexClassTransfer": "amount token dex toPerp", "DeployGasAuction": "token amount",
}
TRANSFERS = ["InternalTransfer", "AccountClassTransfer", "SubAccountTransfer", "SpotTransfer", "PerpDexClassTransfer"]
ORDER = "coin string, side string, limitPx string, sz string, oid bigint, timestamp bigint, triggerCondition string, isTrigger boolean, triggerPx string, isPositionTpsl boolean, reduceOnly boolean, orderType string, origSz string, tif string, cloid string"


def held(value: Column, ok: Column, why: str) -> Column:
    """The value where the rule holds; an error otherwise."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit(why + ": "), F.coalesce(value.cast("string"), F.lit("null")))))


def only_key(json: Column) -> Column:
    """The one key of a JSON object."""
    keys = F.json_object_keys(json)
    return held(keys[0], F.size(keys) == 1, "not one variant")


def _batched(lines: DataFrame, stream: str) -> DataFrame:
    r = lines.select(F.from_json("value", RECORDS[stream], STRICT).alias("r"))
    return r.select(F.col("r.block_number").alias("block_number"), F.posexplode("r.events").alias("event_index", "e"))


def order_statuses(lines: DataFrame, scale: int = 8) -> DataFrame:
    """One row per order status, price and sizes as exact integers; ``priority`` is (timestamp, oid)."""
    e = _batched(lines, "order_statuses").select("block_number", "event_index", "e.time", "e.user", "e.status", "e.order.*")
    side = held(F.col("side"), F.col("side").isin("A", "B"), "side")
    return e.select(
        "block_number", "event_index", "user", "status", "coin", side.alias("side"), "oid", parse_at_scale("limitPx", scale).alias("px"), parse_at_scale("sz", scale).alias("sz"),
        parse_at_scale("origSz", scale).alias("orig_sz"), "isTrigger", "reduceOnly", "tif", F.struct("timestamp", "oid").alias("priority"),
    )


def book_diffs(lines: DataFrame, scale: int = 8) -> DataFrame:
    """One row per diff: ``op`` is new, update or remove; a removal has no size."""
    e = _batched(lines, "raw_book_diffs").select("block_number", "event_index", "e.*")
    text = F.trim(F.col("raw_book_diff"))
    variant = F.when(text.startswith("{"), only_key(text)).otherwise(F.regexp_replace(text, '^"|"$', ""))
    e = e.withColumn("op", held(variant, variant.isin("new", "update", "remove"), "book diff"))
    size = F.coalesce(F.get_json_object("raw_book_diff", "$.new.sz"), F.get_json_object("raw_book_diff", "$.update.sz"))
    size = F.when(F.col("op") != "remove", parse_at_scale(held(size, size.isNotNull(), "size"), scale))
    side = held(F.col("side"), F.col("side").isin("A", "B"), "side")
    return e.select("block_number", "event_index", "user", "oid", "coin", side.alias("side"), parse_at_scale("px", scale).alias("px"), "op", size.alias("sz"))


def signed_actions(lines: DataFrame) -> DataFrame:
    """(round, parent_round, proposer, bundle_index, action_index, kind) of each signed action of an action block.

    Bundles stand at the root or in the block; where both or neither have them the block has no actions.  A bundle is
    an object or a pair that ends with one; an action's kind is its type, or its only key.
    """
    block = "struct<time: string, round: bigint, parent_round: bigint, proposer: string, signed_action_bundles: array<string>>"
    r = lines.select(F.from_json("value", f"abci_block {block}, signed_action_bundles array<string>", STRICT).alias("r")).select("r.*")
    inner, outer = F.col("abci_block.signed_action_bundles"), F.col("signed_action_bundles")
    r = r.select("abci_block.round", "abci_block.parent_round", "abci_block.proposer", F.when(inner.isNull() | outer.isNull(), F.coalesce(inner, outer)).alias("bundles"))
    r = r.select("round", "parent_round", "proposer", F.posexplode("bundles").alias("bundle_index", "b"))
    text = F.when(F.trim("b").startswith("["), F.get_json_object("b", "$[1].signed_actions")).otherwise(F.get_json_object("b", "$.signed_actions"))
    r = r.select("round", "parent_round", "proposer", "bundle_index", F.posexplode(F.from_json(text, "array<string>", STRICT)).alias("action_index", "a"))
    kind = F.coalesce(F.get_json_object("a", "$.action.type"), only_key(F.get_json_object("a", "$.action")))
    return r.select("round", "parent_round", "proposer", "bundle_index", "action_index", held(kind, kind.isin(*ACTION_TYPES), "action type").alias("kind"))


def _required(body: Column, variant: Column, fields: dict[str, str]) -> Column:
    """The body, if it has all fields of its variant."""
    keys = F.json_object_keys(body)
    ok = F.lit(False)
    for name, wanted in fields.items():
        ok = F.when(variant == name, F.size(F.array_except(F.split(F.lit(wanted), " "), keys)) == 0 if wanted else F.lit(True)).otherwise(ok)
    return held(body, ok, "missing fields")


def misc_events(lines: DataFrame) -> DataFrame:
    """(block_number, event_index, hash, kind, variant, delta, body) of each misc event; body is the variant's JSON.

    Ledger updates are Liquidation or Transfer records by their delta; all else is a MiscEvent.
    """
    r = lines.select(F.from_json("value", "block_number bigint, events array<string>", STRICT).alias("r"))
    e = r.select(F.col("r.block_number").alias("block_number"), F.posexplode("r.events").alias("event_index", "e"))
    inner = F.get_json_object("e", "$.inner")
    e = e.withColumn("variant", only_key(inner))
    body = None
    for name in MISC_FIELDS:
        part = F.get_json_object("e", f"$.inner.{name}")
        body = F.when(F.col("variant") == name, part) if body is None else body.when(F.col("variant") == name, part)
    e = e.withColumn("body", _required(body, F.col("variant"), MISC_FIELDS))
    delta_json = F.get_json_object("body", "$.delta")
    e = e.withColumn("delta", F.when(F.col("variant") == "LedgerUpdate", only_key(delta_json)))
    change = None
    for name in DELTA_FIELDS:
        part = F.get_json_object("body", f"$.delta.{name}")
        change = F.when(F.col("delta") == name, part) if change is None else change.when(F.col("delta") == name, part)
    body = F.when(F.col("delta").isNull(), F.col("body")).otherwise(_required(change, F.col("delta"), DELTA_FIELDS))
    kind = F.when(F.col("delta") == "Liquidation", "Liquidation").when(F.col("delta").isin(TRANSFERS), "Transfer").otherwise("MiscEvent")
    place = F.get_json_object("e", "$.hash")
    return e.select("block_number", "event_index", held(place, place != "", "hash").alias("hash"), kind.alias("kind"), "variant", "delta", body.alias("body"))


def order_snapshot(files: DataFrame, scale: int = 8) -> DataFrame:
    """One row per resting order of whole-file snapshots(file, value): file, coin, side (0 bids, 1 asks), position, order.

    A snapshot is a list of [coin, [bids, asks]].
    """
    m = files.select("file", F.explode(F.from_json("value", "array<string>", STRICT)).alias("m"))
    m = m.select("file", F.get_json_object("m", "$[0]").alias("coin"), F.array(F.get_json_object("m", "$[1][0]"), F.get_json_object("m", "$[1][1]")).alias("book"))
    s = m.select("file", held(F.col("coin"), F.col("coin") != "", "coin").alias("coin"), F.posexplode("book").alias("side", "orders"))
    orders = F.from_json(held(F.col("orders"), F.col("orders").isNotNull(), "side"), f"array<struct<{ORDER.replace(' ', ': ').replace(',:', ',')}>>", STRICT)
    s = s.select("file", "coin", "side", F.posexplode(orders).alias("position", "o"))
    whole = F.array_size(F.filter(F.array("o.limitPx", "o.sz", "o.triggerCondition", "o.triggerPx", "o.orderType", "o.origSz"), lambda x: F.coalesce(x != "", F.lit(False)))) == 6
    oid = held(F.col("o.oid"), whole & F.col("o.timestamp").isNotNull() & F.col("o.isTrigger").isNotNull(), "order")
    return s.select("file", "coin", "side", "position", oid.alias("oid"), parse_at_scale("o.limitPx", scale).alias("px"), parse_at_scale("o.sz", scale).alias("sz"), F.col("o.timestamp").alias("timestamp"), F.col("o.isTrigger").alias("trigger"))


#: Kind of each stream's events (fixed values).
STREAM_KINDS = {
    "transactions": "TransactionBlock", "trades": "Trade", "fills": "Fill", "order_statuses": "OrderStatus", "raw_book_diffs": "RawBookDiff",
    "misc_events": "MiscEvent", "market_metadata": "MarketMetadata", "abci_states": "AbciStateSnapshot", "l4_snapshots": "L4Snapshot",
}


def record_kinds(lines: DataFrame, stream: str = "stream") -> DataFrame:
    """lines(stream, value) plus ``kind``, one of twelve: the stream's own, Liquidation or Transfer for misc events that
    hold only such deltas, EmptyBatch for a batch without events.  An unknown stream, or misc events of mixed kinds, raise."""
    kind = F.create_map(*[F.lit(x) for pair in STREAM_KINDS.items() for x in pair])[F.col(stream)]
    batch = ~F.col(stream).isin("abci_states", "l4_snapshots")
    events = F.when(batch, F.from_json(F.get_json_object("value", "$.events"), "array<string>"))
    deltas = F.transform(events, lambda e: F.json_object_keys(F.get_json_object(e, "$.inner.LedgerUpdate.delta"))[0])
    kinds = F.array_distinct(F.transform(deltas, lambda d: F.when(d == "Liquidation", "Liquidation").when(d.isin(TRANSFERS), "Transfer").otherwise("MiscEvent")))
    misc = F.coalesce(held(kinds[0], F.size(kinds) == 1, "mixed kinds"), kind)
    named = F.when(F.size(events) == 0, "EmptyBatch").when((F.col(stream) == "misc_events") & events.isNotNull(), misc).otherwise(kind)
    return lines.withColumn("kind", held(named, kind.isNotNull(), "stream"))
