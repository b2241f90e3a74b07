"""Strict parsers: JSON records under explicit schemas, EVM logs and byte layouts, message families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import parse_at_scale

STRICT = {"mode": "FAILFAST"}
#: Record schemas by stream (fixed values).
RECORDS = {
    "trades": "local_time string, block_time string, block_number bigint, events array<struct<coin: string, side: string, time: string, px: string, sz: string, hash: string, trade_dir_override: string, side_info: array<struct<user: string, start_pos: string, oid: bigint, twap_id: bigint, cloid: string>>>>",
    "order_statuses": "local_time string, block_time string, block_number bigint, events array<struct<time: string, user: string, status: string, order: struct<coin: string, side: string, limitPx: string, sz: string, oid: bigint, timestamp: bigint, triggerCondition: string, isTrigger: boolean, triggerPx: string, isPositionTpsl: boolean, reduceOnly: boolean, orderType: string, origSz: string, tif: string, cloid: string>>>",
    "raw_book_diffs": "local_time string, block_time string, block_number bigint, events array<struct<user: string, oid: bigint, coin: string, side: string, px: string, raw_book_diff: string>>",
    "user_fills": "closedPnl string, coin string, crossed boolean, dir string, hash string, oid bigint, px string, side string, startPosition string, sz string, time bigint, fee string, feeToken string, builderFee string, tid bigint",
    "l2_book": "channel string, data struct<coin: string, time: bigint, levels: array<array<struct<px: string, sz: string, n: bigint>>>>",
    "candles": "T bigint, t bigint, o string, h string, l string, c string, v string, n bigint, i string, s string",
}
#: First 32-byte topic of well-known event signatures (fixed values).
TOPICS = {
    "Transfer": "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef",
    "Approval": "8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925",
    "TransferSingle": "c3d58168c5ae7397731d063d5bbf3d657854427343f4c083240f7aacaa2d0f62",
    "TransferBatch": "4a39dc06d4c0dbc64b70af90fd698a233a518aa5d07e595d983b8c0526c8f7fb",
    "ApprovalForAll": "17307eab39ab6107e8899845ad3d59bd9653f200f220920489ca2b5937696c31",
}
#: Message families: channel to (replacement class, lane).
FAMILIES = {
    "l2Book": ("FullReplace", "provisional"), "trades": ("Incremental", "provisional"), "allMids": ("FullReplace", "provisional"), "bbo": ("FullReplace", "provisional"),
    "candle": ("Tagged", "reference"), "userFills": ("Tagged", "provisional"), "orderUpdates": ("Incremental", "provisional"), "userEvents": ("Incremental", "provisional"),
    "notification": ("Incremental", "evidence"), "subscriptionResponse": ("Tagged", "control"), "pong": ("Tagged", "control"), "error": ("Tagged", "quarantine"),
}


def records(lines: DataFrame, stream: str, column: str = "value") -> DataFrame:
    """Parsed records of a stream; a malformed line raises."""
    return lines.select(F.from_json(F.col(column), RECORDS[stream], STRICT).alias("r")).select("r.*")


def classify(lines: DataFrame, column: str = "value") -> DataFrame:
    """Adds ``kind`` by the fields a record has; unknown kinds are kept as evidence."""
    has = lambda p: F.get_json_object(column, p).isNotNull()
    kind = (
        F.when(has("$.events[0].side_info"), "trades").when(has("$.events[0].order"), "order_statuses").when(has("$.events[0].raw_book_diff"), "raw_book_diffs")
        .when(has("$.channel"), "message").when(has("$.abci_block"), "transactions").otherwise("unknown")
    )
    return lines.withColumn("kind", kind)


def trade_legs(batches: DataFrame, scale: int = 8) -> DataFrame:
    """One row per trade and side, price and quantity as exact integers."""
    t = batches.select("block_number", F.posexplode("events").alias("event_index", "e"))
    t = t.select("block_number", "event_index", "e.*").select("*", F.posexplode("side_info").alias("leg", "who"))
    return t.select(
        "block_number", "event_index", "coin", "side", "hash", "leg", F.col("who.user").alias("user"), F.col("who.oid").alias("oid"),
        parse_at_scale("px", scale).alias("px"), parse_at_scale("sz", scale).alias("sz"), parse_at_scale("who.start_pos", scale).alias("start_pos"),
    )


def book_levels(messages: DataFrame, scale: int = 8) -> DataFrame:
    """Levels of book messages: side 0 bids, 1 asks, in order."""
    sides = messages.select(F.col("data.coin").alias("coin"), F.col("data.time").alias("time"), F.posexplode("data.levels").alias("side", "levels"))
    lv = sides.select("coin", "time", "side", F.posexplode("levels").alias("level", "l"))
    return lv.select("coin", "time", "side", "level", parse_at_scale("l.px", scale).alias("px"), parse_at_scale("l.sz", scale).alias("sz"), F.col("l.n").alias("n"))


def families(messages: DataFrame, channel: str = "channel") -> DataFrame:
    """Replacement class and lane of each message by a small broadcast table; unknown channels go to quarantine."""
    rows = [(c, k, lane) for c, (k, lane) in FAMILIES.items()]
    dim = messages.sparkSession.createDataFrame(rows, f"{channel} string, family string, lane string")
    out = messages.join(F.broadcast(dim), channel, "left")
    return out.withColumn("lane", F.coalesce("lane", F.lit("quarantine")))


def word(data: Column, i: int) -> Column:
    """The i-th 32-byte word of a byte string."""
    return F.substring(data, 32 * i + 1, 32)


def address(topic: Column) -> Column:
    return F.lower(F.hex(F.substring(topic, 13, 20)))


def decode_logs(logs: DataFrame) -> DataFrame:
    """Token events of logs(address, topic0..topic3, data): standard, event, sender, receiver, amount or id words.

    Three indexed topics make a transfer an ERC-20 one, four an ERC-721 one; ERC-1155 events carry id and value in
    their data.  Others have null standards.
    """
    t0 = F.lower(F.hex("topic0"))
    event = None
    for name, topic in TOPICS.items():
        event = F.when(t0 == topic, name) if event is None else event.when(t0 == topic, name)
    nft = F.col("topic3").isNotNull()
    standard = F.when(event.isin("TransferSingle", "TransferBatch", "ApprovalForAll"), "erc1155").when(event.isin("Transfer", "Approval"), F.when(nft, "erc721").otherwise("erc20"))
    many = event.isin("TransferSingle", "TransferBatch")
    hexed = lambda c: F.lower(F.hex(c))
    return logs.select(
        "*", event.alias("event"), standard.alias("standard"), address(F.when(many, F.col("topic2")).otherwise(F.col("topic1"))).alias("sender"),
        address(F.when(many, F.col("topic3")).otherwise(F.col("topic2"))).alias("receiver"),
        F.when(event == "TransferSingle", hexed(word(F.col("data"), 1))).when((event == "Transfer") & ~nft, hexed(word(F.col("data"), 0))).alias("amount_hex"),
        F.when(event == "TransferSingle", hexed(word(F.col("data"), 0))).when((event == "Transfer") & nft, hexed(F.col("topic3"))).alias("token_hex"),
    )


def native_transfers(transactions: DataFrame) -> DataFrame:
    """Transactions that move native value: a positive value and a receiver."""
    positive = F.regexp_like("value", F.lit("[1-9]"))
    return transactions.where(positive & F.col("to_address").isNotNull()).select("block_number", "tx_index", "from_address", "to_address", "value")


def action_bytes(data: Column) -> Column:
    """Version (1 byte), action (3 bytes, big-endian) and payload of a writer call; shorter inputs are null."""
    version = F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("int")
    action = F.conv(F.hex(F.substring(data, 2, 3)), 16, 10).cast("int")
    return F.when(F.octet_length(data) >= 4, F.struct(version.alias("version"), action.alias("action"), F.substring(data, 5, 2147483647).alias("payload")))


def upcast(version: Column) -> Column:
    """The version, if it is one of 1.0.x; an error otherwise."""
    return F.when(F.regexp_like(version, F.lit(r"^1\.0\.\d+$")), version).otherwise(F.raise_error(F.concat(F.lit("unsupported version "), version)).cast("string"))


def disposition(trades: DataFrame, catalog: DataFrame) -> DataFrame:
    """Maps records to markets by a versioned catalog: mapped, unknown market, or outside the version's range."""
    j = trades.join(F.broadcast(catalog), (trades["coin"] == catalog["symbol"]) & trades["block_number"].between(catalog["from_block"], catalog["to_block"]), "left")
    return j.withColumn("disposition", F.when(F.col("market_id").isNotNull(), "Mapped").otherwise("EvidenceOnly"))
