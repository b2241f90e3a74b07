"""Fail-closed admission: typed observations, scored dimensions, confirmation classes, manifests, query guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIRMED = ("COMMITTED_PRIMARY", "COMMITTED_INDEPENDENT", "CORRECTED")
MOST_ROWS = 1024


def admit(value: Column, kind: Column, wanted: str) -> Column:
    """Observed, Missing or Malformed: a value of another kind is malformed, never converted."""
    return F.when(kind == "Missing", "Missing").when(value.isNull(), "Missing").when(kind == wanted, "Observed").otherwise("Malformed")


def proof(*admissions: Column) -> Column:
    """True where all are observed; an error otherwise, so it must be a kept column."""
    ok = F.lit(True)
    for a in admissions:
        ok = ok & (a == "Observed")
    return F.when(ok, True).otherwise(F.raise_error(F.lit("an observation is missing")).cast("boolean"))


def presence(depth: Column) -> Column:
    """Presence from depth: missing stays missing, any depth is presence."""
    return F.when(depth.isNotNull(), True)


def depth(present: Column) -> Column:
    """Depth cannot be made from presence: missing stays missing, anything else is refused."""
    return F.when(present.isNull(), F.lit(None).cast("bigint")).otherwise(F.raise_error(F.lit("presence holds no depth")).cast("bigint"))


def scored(normalised: Column, low: Column, high: Column, sample_milli: Column, health: Column) -> Column:
    """The reason a scored dimension is invalid, or null: unit bounds, value inside its interval, a healthy sample."""
    unit = 1_000_000
    return (
        F.when(F.abs(normalised) > unit, "bounds").when(low > high, "interval").when(~normalised.between(low, high), "outside")
        .when(sample_milli <= 0, "sample").when(health == "Red", "health")
    )


def snapshot_errors(effective: Column, known: Column, superseded: Column, revision: Column, values: Column, health: Column) -> Column:
    """The first broken rule of a feature snapshot, or null.  ``values``: map of name to value, null is missing."""
    return (
        F.when(revision < 1, "revision").when(known < effective, "known before effective").when(superseded <= known, "superseded before known")
        .when(F.size(values) == 0, "empty").when((health == "Red") & F.exists(F.map_values(values), lambda v: v.isNotNull()), "red with values")
    )


def confirmed(kind: Column) -> Column:
    return kind.isin(*CONFIRMED)


def undeclared(features: DataFrame, manifest: DataFrame, key: str = "feature") -> DataFrame:
    """Features that the manifest does not list: must be empty."""
    return features.join(manifest.select(key), key, "left_anti")


def requested_rows(query: str | None, most: int = MOST_ROWS) -> int | None:
    """The row limit a request asks for: only ``limit`` is known, once, within bounds."""
    if not query:
        return None
    parts = [p.split("=", 1) for p in query.split("&")]
    if len(parts) != 1 or len(parts[0]) != 2 or parts[0][0] != "limit" or not parts[0][1].isdigit():
        raise ValueError("only one limit=N is accepted")
    n = int(parts[0][1])
    if not 1 <= n <= most:
        raise ValueError(f"limit must be 1 to {most}")
    return n


def aligned(block: int, archive: int, state: int) -> None:
    if not block == archive == state:
        raise ValueError("watermarks differ")


def by_id(rows: DataFrame, ids: list[str], key: str = "id") -> DataFrame:
    """Rows of the wanted ids in their order; a missing id is an error."""
    want = rows.sparkSession.createDataFrame(list(enumerate(ids)), f"_at int, {key} string")
    out = F.broadcast(want).join(rows.withColumn("_found", F.lit(True)), key, "left")
    ok = F.when(F.col("_found"), F.col("_at")).otherwise(F.raise_error(F.concat(F.lit("unknown id "), F.col(key))).cast("int"))
    return out.withColumn("_at", ok).orderBy("_at").drop("_at", "_found")
