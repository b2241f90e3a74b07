"""Fixed, versioned table schemas; nothing is inferred."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Columns of each dataset, as ``name type`` (fixed values).
DATASETS = {
    "canonical_events": "chain_id string, block_height decimal(20,0), block_time_micros bigint, canonical_block_hash binary, confirmation_class string, transaction_id string, transaction_index bigint, canonical_event_index bigint, event_id string, event_kind string, schema_version string, payload_hash binary, canonical_event_envelope_pb binary",
    "raw_source_observations": "chain_id string, source_id string, source_version string, observation_class string, cursor_epoch string, cursor_offset decimal(20,0), received_wall_micros bigint, received_monotonic_nanos decimal(20,0), parser_schema_version string, content_hash binary, warnings_json string, payload binary",
    "reconciled_snapshots": "chain_id string, snapshot_family string, snapshot_class string, as_of_block decimal(20,0), observed_at_micros bigint, schema_version string, payload_hash binary, canonical_snapshot_envelope_pb binary",
    "reference_snapshots": "chain_id string, snapshot_family string, snapshot_class string, as_of_block decimal(20,0), observed_at_micros bigint, schema_version string, payload_hash binary, canonical_snapshot_envelope_pb binary",
    "unknown_payloads": "chain_id string, capability_id string, parser_version string, observed_at_micros bigint, content_hash binary, reason_code string, payload binary",
    "l4_checkpoints": "market_id string, as_of_block decimal(20,0), sequence decimal(20,0), max_orders decimal(20,0), order_count bigint, state_hash binary, checkpoint_bytes binary",
    "market_positioning": "cohort_id string, entity_id string, exposure_usd string, entry_bps_from_mark bigint, independence_ppm bigint, pain_state string",
    "historical_object_manifest": "bucket string, key string, etag string, content_hash binary, dataset string, dataset_version string, byte_count decimal(20,0), first_block decimal(20,0), last_block decimal(20,0), first_event_time_micros bigint, last_event_time_micros bigint, parser_build string, imported_at_micros bigint, gap_status string, requester_pays_billed_bytes decimal(20,0)",
    "evm_blocks": "chain_id decimal(20,0), block_number decimal(20,0), block_hash binary, parent_hash binary, timestamp decimal(20,0), miner binary, gas_limit string, gas_used string, base_fee_per_gas string, pace string, tx_count bigint, fact_hash binary",
    "evm_logs": "chain_id decimal(20,0), block_hash binary, block_number decimal(20,0), tx_hash binary, tx_index bigint, log_index bigint, address binary, topic0 binary, topic1 binary, topic2 binary, topic3 binary, data binary, fact_hash binary",
    "evm_receipts": "chain_id decimal(20,0), block_hash binary, block_number decimal(20,0), tx_hash binary, tx_index bigint, status string, gas_used string, cumulative_gas_used string, contract_address binary, logs_count bigint, fact_hash binary",
    "evm_transactions": "chain_id decimal(20,0), block_hash binary, block_number decimal(20,0), tx_hash binary, tx_hash_observed boolean, tx_index bigint, type_name string, from_address binary, to_address binary, value string, input binary, extra_json string, is_system boolean, fact_hash binary",
}


def schema(dataset: str) -> T.StructType:
    return T.StructType.fromDDL(DATASETS[dataset])


def fingerprint(s: T.StructType) -> str:
    """SHA-256 of names and types in order; nullability and metadata do not count."""
    return hashlib.sha256("|".join(f"{f.name}:{f.dataType.simpleString()}" for f in s.fields).encode()).hexdigest()


def read(spark: SparkSession, dataset: str, *paths: str) -> DataFrame:
    """Read Parquet under the dataset's schema; files of another schema are refused before any scan."""
    want = schema(dataset)
    found = spark.read.parquet(*paths).schema
    found = T.StructType([f for f in found.fields if f.name not in ("chain", "date", "hour")])
    if fingerprint(found) != fingerprint(want):
        raise ValueError(f"{dataset}: schema {fingerprint(found)[:12]} is not {fingerprint(want)[:12]}")
    return spark.read.schema(want).parquet(*paths)
