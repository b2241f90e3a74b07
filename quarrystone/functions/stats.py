"""Exact order statistics and robust statistics over sorted arrays of integers.

``sorted_`` arguments are ``array_sort(collect_list(x))`` columns: one key's values, exact where approximate quantiles
are not wanted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fixed import PPM, big, col, half_even_div, trunc_div, trunc_wide, wide


def sorted_list(x) -> Column:
    return F.array_sort(F.collect_list(col(x)))


def at(sorted_: Column, index: Column) -> Column:
    return F.get(sorted_, index.cast("int"))


def lower_median(s) -> Column:
    return at(col(s), trunc_div(F.size(col(s)) - 1, F.lit(2)))


def upper_median(s) -> Column:
    return at(col(s), trunc_div(F.size(col(s)), F.lit(2)))


def mean_median(s) -> Column:
    """Mean of the two middle values, toward zero."""
    return trunc_div(lower_median(s) + upper_median(s), F.lit(2))


def even_median(s) -> Column:
    """Mean of the two middle values, ties to even."""
    return half_even_div(wide(lower_median(s)) + wide(upper_median(s)), F.lit(2)).cast("bigint")


def mad(s, median) -> Column:
    return mean_median(F.array_sort(F.transform(col(s), lambda x: F.abs(x - col(median)))))


def robust_z(value, median, mad_) -> Column:
    """(value - median) * 674500 / MAD toward zero; null where the MAD is zero (callers withhold or raise)."""
    return F.when(col(mad_) != 0, trunc_wide((wide(value) - wide(median)) * 674500, wide(mad_)).cast("bigint"))


def quantile_floor(s, q_ppm: int) -> Column:
    """Value at index (n - 1) * q / 1e6, floored."""
    return at(col(s), trunc_div((F.size(col(s)) - 1).cast("bigint") * q_ppm, F.lit(PPM)))


def percentile_floor(s, pct: int) -> Column:
    return at(col(s), trunc_div((F.size(col(s)) - 1).cast("bigint") * pct, F.lit(100)))


def tail_mean(s, count: Column) -> Column:
    """Mean of the ``count`` smallest values, toward zero."""
    worst = F.slice(col(s), F.lit(1), count.cast("int"))
    return trunc_div(F.aggregate(worst, F.lit(0).cast("bigint"), lambda a, x: a + x), count)


def array_sum(a, kind: str = "bigint") -> Column:
    return F.aggregate(col(a), F.lit(0).cast(kind), lambda s, x: (s + x).cast(kind))


def effective_sample_milli(n, square_dev, lag_products) -> Column:
    """Lag-1 effective sample size, in thousandths, from the count, the sum of squared deviations and the sum of
    products of neighbouring deviations.  A constant series counts in full."""
    n = col(n)
    rho = trunc_wide(wide(lag_products) * PPM, wide(F.greatest(col(square_dev), F.lit(1)))).cast("bigint")
    rho = F.least(F.greatest(rho, F.lit(0)), F.lit(990_000))
    ess = F.least(n * 1000, F.greatest(F.lit(1000), trunc_div(n * 1000 * (F.lit(PPM) - rho), F.lit(PPM) + rho)))
    return F.when(n == 1, F.lit(1000).cast("bigint")).when(col(square_dev) == 0, n * 1000).otherwise(ess)


def order_statistics(df: DataFrame, keys: list[str], value: str, picks: dict[str, Column], least: int = 1) -> DataFrame:
    """Keys, ``n`` and for each name of ``picks`` the value at a 0-based place (an expression of ``n``) of the key's
    values in order; keys of fewer than ``least`` values are left out.

    A key's rows are sorted by Spark, which spills, and stream past; nothing holds them in one value.
    """
    w = Window.partitionBy(*keys).orderBy(value)
    sizes = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    placed = df.select(*keys, F.col(value).alias("_v"), (F.row_number().over(w) - 1).alias("_at")).join(sizes, same)
    return placed.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("_at") == at_, F.col("_v"))).alias(name) for name, at_ in picks.items()])


def shares_upto(df: DataFrame, keys: list[str], value: str, out: str, rows: int = 4096) -> DataFrame:
    """``df`` plus the share, in ppm, of the key's rows whose value is not larger.

    Values are cut into buckets of equal width, about ``rows`` rows each if they were spread evenly; only bucket counts
    of a key meet in one place.
    """
    lo, hi, n = df.agg(F.min(value), F.max(value), F.count(F.lit(1))).first()
    width = max(1, ((hi or 0) - (lo or 0)) * rows // max(n, 1))
    df = df.withColumn("_b", F.floor((F.col(value) - F.lit(lo or 0)) / width))
    local = Window.partitionBy(*keys, "_b").orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    counts = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_at"), before.alias("_before"), F.sum("_c").over(whole).alias("_n"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]) & F.col("_b").eqNullSafe(F.col("_at"))
    placed = df.withColumn("_upto", F.count(F.lit(1)).over(local)).join(counts, same)
    return placed.withColumn(out, trunc_div((F.col("_before") + F.col("_upto")) * PPM, "_n")).drop("_b", "_at", "_upto", "_before", "_n", *[f"_k_{k}" for k in keys])


def lag_moments(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """n, total, mean (toward zero), square_dev and lag_products of each key's series in ``order``.

    The sums of raw products add up before the shuffle of the last step, and deviations follow from them:
    sum (x - m)(p - m) = sum xp - m (sum x + sum p over the pairs) + m^2 pairs.
    """
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    x, p = wide(value), wide("_p")
    s = df.withColumn("_p", before).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.sum((x * x).cast("decimal(38,0)")).alias("_xx"), F.sum((x * p).cast("decimal(38,0)")).alias("_xp"),
        F.sum(F.when(F.col("_p").isNotNull(), F.col(value) + F.col("_p"))).alias("_sum"), F.count("_p").alias("_pairs"),
    )
    s = s.withColumn("mean", trunc_div("total", "n"))
    m = wide("mean")
    square = (F.col("_xx") - m * wide("total") * 2 + m * m * wide("n")).cast("decimal(38,0)")
    products = (F.coalesce("_xp", F.lit(0)) - m * wide(F.coalesce("_sum", F.lit(0))) + m * m * wide("_pairs")).cast("decimal(38,0)")
    return s.select(key, "n", "total", "mean", square.alias("square_dev"), products.alias("lag_products"))


def pair_score(p: np.ndarray, x: np.ndarray) -> int:
    """Concordant minus discordant pairs of two arrays in step; ties count nothing.  n log n: sorted by ``p``, the
    values of ``x`` are merged in blocks of doubling size, and only pairs with a smaller ``p`` count."""
    order = np.lexsort((x, p))
    p, x = p[order], x[order]
    start = np.searchsorted(p, p, "left")  # rows before it have a smaller p
    below, above = _before(x, start, "left"), _before(x, start, "right")
    return int(below.sum() - (start - above).sum())


def _before(x: np.ndarray, stop: np.ndarray, side: str) -> np.ndarray:
    """For each i, how many of x[:stop[i]] are smaller than x[i] (``right``: not larger)."""
    out, n, size = np.zeros(len(x), np.int64), len(x), 1
    while size <= n:  # the prefix [0, stop) is cut into sorted blocks by the bits of stop
        used = np.flatnonzero(stop & size)
        if len(used):
            first = stop[used] // (2 * size) * (2 * size)
            for at in np.unique(first).tolist():
                block = np.sort(x[at : at + size])
                who = used[first == at]
                out[who] += np.searchsorted(block, x[who], side)
        size *= 2
    return out


def kendall_scores(df: DataFrame, key: str, prediction: str, outcome: str) -> DataFrame:
    """Key, score (concordant minus discordant pairs) and pairs of each key with two rows at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bounds = b.column(1).offsets.to_numpy()
            values = b.column(1).flatten()
            p, x = (values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = bounds - bounds[0]
            score = [pair_score(p[i:j], x[i:j]) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.int64())], [key, "score"])

    kind = df.schema[key].dataType.simpleString()
    lists = df.groupBy(key).agg(F.collect_list(F.struct(F.col(prediction).cast("bigint"), F.col(outcome).cast("bigint"))).alias("s")).where("size(s) > 1")
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    out = lists.mapInArrow(run, f"{key} {kind}, score long").join(sizes, key)
    return out.select(key, "score", F.expr("_n * (_n - 1) div 2").alias("pairs"))


def squared_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: wide((big(x) - big(y)) * (big(x) - big(y)))), F.lit(0).cast("decimal(38,0)"), lambda s, d: (s + d).cast("decimal(38,0)"))
