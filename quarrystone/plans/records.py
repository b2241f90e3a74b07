"""Record parsers over JSON made from the tables: what comes out must be what the tables hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import node
from .registry import EV, LI, events, lines, query, table

DECIMAL = "concat(cast(({0}) div 100 as string), '.', lpad(cast(({0}) % 100 as string), 2, '0'))"


@query("""SELECT o_orderkey AS block_number, CAST(0 AS INTEGER) AS event_index, CAST(o_custkey AS VARCHAR) AS "user", CASE WHEN o_orderstatus = 'F' THEN 'filled' ELSE 'open' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS side,
o_orderkey * 3 AS oid, CAST(round(o_totalprice * 100) AS BIGINT) * 1000000 AS px, o_custkey * 100000000 AS sz, o_orderkey % 3 = 0 AS trigger FROM orders""")
def order_status_records(spark, d):
    """Order statuses through their JSON records."""
    cents = "cast(round(o_totalprice * 100) as bigint)"
    order = (
        "named_struct('coin', 'C', 'side', if(o_orderkey % 2 = 0, 'A', 'B'), 'limitPx', " + DECIMAL.format(cents) + ", 'sz', cast(o_custkey as string), 'oid', o_orderkey * 3, 'timestamp', o_orderkey,"
        " 'triggerCondition', 'N/A', 'isTrigger', o_orderkey % 3 = 0, 'triggerPx', '0.0', 'isPositionTpsl', false, 'reduceOnly', false, 'orderType', 'Limit', 'origSz', cast(o_custkey as string), 'tif', 'Gtc', 'cloid', cast(null as string))"
    )
    event = f"named_struct('time', 't', 'user', cast(o_custkey as string), 'status', if(o_orderstatus = 'F', 'filled', 'open'), 'order', {order})"
    made = table(spark, d, "orders").selectExpr(f"to_json(named_struct('local_time', 'l', 'block_time', 'b', 'block_number', o_orderkey, 'events', array({event}))) AS value")
    out = node.order_statuses(made)
    return out.select("block_number", "event_index", "user", "status", "side", "oid", F.col("px").cast("bigint").alias("px"), F.col("sz").cast("bigint").alias("sz"), F.col("isTrigger").alias("trigger"))


@query(f"""WITH {EV} SELECT event_id AS block_number, CAST(0 AS INTEGER) AS event_index, event_id * 2 AS oid, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS side, abs(cents) * 1000000 AS px,
CASE event_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'update' ELSE 'remove' END AS op, CASE WHEN event_id % 3 < 2 THEN (user_id + 1) * 100000000 END AS sz FROM ev""")
def book_diff_records(spark, d):
    """Book diffs through their JSON records: new, update and remove."""
    diff = "case event_id % 3 when 0 then concat('{\"new\":{\"sz\":\"', user_id + 1, '\"}}') when 1 then concat('{\"update\":{\"sz\":\"', user_id + 1, '.00\"}}') else '\"remove\"' end"
    value = (
        "concat('{\"local_time\":\"l\",\"block_time\":\"b\",\"block_number\":', event_id, ',\"events\":[{\"user\":\"u\",\"oid\":', event_id * 2, ',\"coin\":\"C\",\"side\":\"', if(event_id % 2 = 0, 'A', 'B'),"
        " '\",\"px\":\"', " + DECIMAL.format("abs(cents)") + f", '\",\"raw_book_diff\":', {diff}, '}}]}}')"
    )
    out = node.book_diffs(events(spark, d).select(F.expr(value).alias("value")))
    return out.select("block_number", "event_index", "oid", "side", F.col("px").cast("bigint").alias("px"), "op", F.col("sz").cast("bigint").alias("sz"))


@query("""SELECT o_orderkey AS round, o_orderkey - 1 AS parent_round, b AS bundle_index, a AS action_index, CASE (o_orderkey + a) % 3 WHEN 0 THEN 'order' WHEN 1 THEN 'cancel' ELSE 'noop' END AS kind
FROM (SELECT o_orderkey, CAST(unnest(range(o_custkey % 3)) AS INTEGER) AS b FROM orders WHERE o_orderkey % 5 <> 4), (SELECT CAST(unnest([0, 1]) AS INTEGER) AS a)""")
def action_block_records(spark, d):
    """Signed actions of blocks whose bundles stand at the root, in the block, in both (then none count) or nowhere."""
    kind = lambda a: f"case (o_orderkey + {a}) % 3 when 0 then '{{\"type\":\"order\"}}' when 1 then '{{\"cancel\":{{}}}}' else '{{\"type\":\"noop\",\"x\":1}}' end"
    actions = f"concat('{{\"signed_actions\":[{{\"action\":', {kind(0)}, '}},{{\"action\":', {kind(1)}, '}}]}}')"
    bundle = f"if(o_orderkey % 2 = 0, concat('[\"0xb\",', {actions}, ']'), {actions})"
    bundles = f"concat('[', array_join(array_repeat({bundle}, cast(o_custkey % 3 as int)), ','), ']')"
    inside, outside = "o_orderkey % 5 in (0, 1, 4)", "o_orderkey % 5 in (2, 3, 4)"
    value = (
        f"concat('{{\"abci_block\":{{\"time\":\"t\",\"round\":', o_orderkey, ',\"parent_round\":', o_orderkey - 1, ',\"proposer\":\"p\"', if({inside}, concat(',\"signed_action_bundles\":', {bundles}), ''), '}}',"
        f" if({outside}, concat(',\"signed_action_bundles\":', {bundles}), ''), '}}')"
    )
    out = node.signed_actions(table(spark, d, "orders").select(F.expr(value).alias("value")))
    return out.select("round", "parent_round", "bundle_index", "action_index", "kind")


@query(f"""WITH {EV} SELECT event_id AS block_number, CAST(0 AS INTEGER) AS event_index, 'h' || event_id AS hash,
CASE event_id % 4 WHEN 2 THEN 'Liquidation' WHEN 3 THEN 'Transfer' ELSE 'MiscEvent' END AS kind, CASE event_id % 4 WHEN 0 THEN 'CDeposit' WHEN 1 THEN 'Funding' ELSE 'LedgerUpdate' END AS variant,
CASE event_id % 4 WHEN 2 THEN 'Liquidation' WHEN 3 THEN 'InternalTransfer' END AS delta, CASE event_id % 4 WHEN 0 THEN user_id WHEN 1 THEN cents WHEN 3 THEN user_id ELSE 7 END AS amount FROM ev""")
def misc_event_records(spark, d):
    """Misc events and ledger updates through their JSON records, with one figure of each body."""
    inner = (
        "case event_id % 4 when 0 then concat('{\"CDeposit\":{\"user\":\"u\",\"amount\":\"', user_id, '\"}}')"
        " when 1 then concat('{\"Funding\":{\"coin\":\"C\",\"usdc\":\"', cents, '\",\"szi\":\"1\",\"fundingRate\":\"0\",\"nSamples\":1}}')"
        " when 2 then '{\"LedgerUpdate\":{\"users\":[\"u\"],\"delta\":{\"Liquidation\":{\"liquidatedNtlPos\":\"7\",\"accountValue\":\"1\",\"leverageType\":\"Cross\",\"liquidatedPositions\":[]}}}}'"
        " else concat('{\"LedgerUpdate\":{\"users\":[],\"delta\":{\"InternalTransfer\":{\"usdc\":\"', user_id, '\",\"user\":\"a\",\"destination\":\"b\",\"fee\":\"0\"}}}}') end"
    )
    value = f"concat('{{\"local_time\":\"l\",\"block_time\":\"b\",\"block_number\":', event_id, ',\"events\":[{{\"time\":\"t\",\"hash\":\"h', event_id, '\",\"inner\":', {inner}, '}}]}}')"
    out = node.misc_events(events(spark, d).select(F.expr(value).alias("value")))
    figure = F.coalesce(*[F.get_json_object("body", f"$.{k}") for k in ("amount", "usdc", "liquidatedNtlPos")]).cast("bigint")
    return out.select("block_number", "event_index", "hash", "kind", "variant", "delta", figure.alias("amount"))


@query(f"""WITH {LI} SELECT 'f' || l_orderkey AS file, 'M' || l_suppkey AS coin, CAST(l_linenumber % 2 AS INTEGER) AS side, l_partkey AS oid, px * 1000000 AS px, qty * 100000000 AS sz, l_linenumber % 4 = 0 AS trigger FROM li""")
def order_snapshot_records(spark, d):
    """Resting orders of whole-file snapshots: one file for each order key, one market for each of its lines."""
    order = (
        "concat('{\"coin\":\"C\",\"side\":\"B\",\"limitPx\":\"', " + DECIMAL.format("px") + ", '\",\"sz\":\"', qty, '\",\"oid\":', l_partkey, ',\"timestamp\":1,\"triggerCondition\":\"N/A\",\"isTrigger\":', l_linenumber % 4 = 0,"
        " ',\"triggerPx\":\"0.0\",\"isPositionTpsl\":false,\"reduceOnly\":false,\"orderType\":\"Limit\",\"origSz\":\"', qty, '\",\"tif\":null}')"
    )
    pair = f"concat('[\"M', l_suppkey, '\",[[', if(l_linenumber % 2 = 0, {order}, ''), '],[', if(l_linenumber % 2 = 1, {order}, ''), ']]]')"
    made = lines(spark, d).select("l_orderkey", F.expr(pair).alias("p")).groupBy("l_orderkey").agg(F.collect_list("p").alias("ps"))
    files = made.select(F.expr("concat('f', l_orderkey)").alias("file"), F.expr("concat('[', array_join(ps, ','), ']')").alias("value"))
    out = node.order_snapshot(files)
    return out.select("file", "coin", "side", "oid", F.col("px").cast("bigint").alias("px"), F.col("sz").cast("bigint").alias("sz"), "trigger")
