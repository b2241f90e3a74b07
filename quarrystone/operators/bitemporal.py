"""Point-in-time operators: visibility, latest visible row, as-of and interval joins, supersession.

As-of joins are a union sorted by key and time with ``last(ignoreNulls)``: one shuffle by key, no pair explosion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(effective: Column, known: Column, superseded: Column | None, at: Column | int, known_at: Column | int) -> Column:
    at, known_at = (x if isinstance(x, Column) else F.lit(x) for x in (at, known_at))
    live = (effective <= at) & (known <= known_at)
    return live if superseded is None else live & (superseded.isNull() | (superseded > known_at))


def latest(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The row of largest ``order`` for each key; the order must end in an ordinal so that the last row wins ties.

    ``max_by`` over a struct combines before the shuffle, so a hot key costs one row for each task.
    """
    best = F.max_by(F.struct(*values), F.struct(*order)).alias("_row")
    out = rows.groupBy(*keys).agg(best) if keys else rows.agg(best).where("_row is not null")
    return out.select(*keys, "_row.*")


def required(found: Column, message: str) -> Column:
    """The value, or an error where it is missing: as-of lookups that must not miss."""
    return F.coalesce(found, F.raise_error(F.lit(message)))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str, values: list[str], ordinal: str) -> DataFrame:
    """For each left row the latest right row of its key with right_time <= time; ties go to the larger ordinal.

    A null key or time finds nothing and is never found.
    """
    for c in (*keys, right_time):
        right = right.where(F.col(c).isNotNull())
    lf = left.withColumn("_t", F.col(time)).withColumn("_side", F.lit(1)).withColumn("_o", F.lit(None).cast(right.schema[ordinal].dataType))
    rf = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(ordinal).alias("_o"), F.struct(*values).alias("_v"))
    both = lf.withColumn("_v", F.lit(None).cast(rf.schema["_v"].dataType)).unionByName(rf, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*left.columns, "_v.*")


def in_force(events: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """The last non-null ``value`` strictly before each row of its key: later changes do not rewrite history."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn(out, F.last(value, ignorenulls=True).over(w))


def interval_first(
    left: DataFrame, right: DataFrame, keys: list[str], time: str, left_id: str, right_id: str, reach: int, values: list[str]
) -> DataFrame:
    """For each left row the first right row, by ``right_id``, of its key with 0 < right time - left time <= reach.

    Times are cut into buckets of ``reach``, so a left row meets its own bucket and the next by equality: the
    range join becomes an equi-join that a hot key shares among its buckets.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(reach)).cast("bigint")
    lf = left.withColumn("_b", F.explode(F.array(bucket(time), bucket(time) + 1)))
    rf = right.select(*keys, F.col(time).alias("_rt"), F.col(right_id).alias("_rid"), *[F.col(v).alias(f"r_{v}") for v in values], bucket(time).alias("_b"))
    pairs = lf.join(rf, [*keys, "_b"]).where((F.col("_rt") > F.col(time)) & (F.col("_rt") - F.col(time) <= reach))
    best = F.min_by(F.struct((F.col("_rt") - F.col(time)).alias("lag"), F.col("_rid").alias("r_id"), *[F.col(f"r_{v}") for v in values]), F.col("_rid"))
    return pairs.groupBy(left_id).agg(best.alias("_m")).select(left_id, "_m.*")


def supersede(rows: DataFrame, keys: list[str], order: list[str], known: str) -> DataFrame:
    """Adds superseded_at: the known time of the next version of the key."""
    return rows.withColumn("superseded_at", F.lead(known).over(Window.partitionBy(*keys).orderBy(*order)))


def overlaps(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    return (a_from <= b_to) & (b_from <= a_to)


def fold_class(height: Column, label_to: Column, fold: dict[str, int | None]) -> Column:
    """Class of a row in a walk-forward fold.

    ``fold`` holds training_from/to, validation_from/to, holdout_from, purge (horizon) and embargo lengths.
    Precedence: holdout, validation, outside training, embargo, purge or label overlap, train.
    """
    vf, vt, tf, tt = fold["validation_from"], fold["validation_to"], fold["training_from"], fold["training_to"]
    purge_from = max(vf - fold["purge"], tf)
    embargo_from = max(purge_from - fold["embargo"], tf)
    return (
        F.when(height >= fold["holdout_from"], "holdout")
        .when(height.between(vf, vt), "validation")
        .when(~height.between(tf, tt), "outside")
        .when(height.between(embargo_from, purge_from - 1), "embargo")
        .when(height.between(purge_from, vf - 1) | overlaps(height, label_to, F.lit(vf), F.lit(vt)), "purged")
        .otherwise("train")
    )
