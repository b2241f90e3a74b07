"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register the function under its name; ``sql`` runs on the same tables."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")


def days(c: str) -> Column:
    return F.expr(f"cast(timestampdiff(DAY, timestamp_ntz'1970-01-01 00:00:00', {c}) as bigint)")


def cents(c: str) -> Column:
    return F.expr(f"cast(round({c} * 100) as bigint)")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, us, user_id, event_type, cents: the form all event queries start from."""
    return table(spark, sf_dir, "events").select("event_id", micros("ts").alias("us"), "user_id", "event_type", cents("value").alias("cents"))


EV = "ev AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"
LI = (
    "li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS qty,"
    " CAST(round(l_extendedprice * 100) AS BIGINT) AS px, CAST(round(l_discount * 10000) AS BIGINT) AS disc,"
    " CAST(round(l_tax * 10000) AS BIGINT) AS tax, l_returnflag, l_linestatus, epoch_us(l_shipdate) // 86400000000 AS day FROM lineitem)"
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in integers: qty, px (cents), disc and tax (bps), day."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr("cast(l_quantity as bigint)").alias("qty"), cents("l_extendedprice").alias("px"),
        F.expr("cast(round(l_discount * 10000) as bigint)").alias("disc"), F.expr("cast(round(l_tax * 10000) as bigint)").alias("tax"),
        "l_returnflag", "l_linestatus", days("l_shipdate").alias("day"),
    )
