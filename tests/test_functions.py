"""Exact arithmetic against Python integers."""

from decimal import Decimal
from math import isqrt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
from pyspark.sql import functions as F

from quarrystone.functions import fixed as fx
from quarrystone.functions import stats

WHOLE = st.integers(-(10**17), 10**17)


def ref(a, b, mode):
    q, r = divmod(a, b)
    if mode == "floor":
        return q
    if mode == "ceiling":
        return q + (r != 0)
    if mode == "toward_zero":
        return q + (r != 0 and (a < 0) != (b < 0))
    twice = 2 * abs(r)
    return q + (twice > abs(b) or (twice == abs(b) and q % 2 != 0))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(WHOLE, st.integers(-(10**9), 10**9).filter(bool)), min_size=1, max_size=40))
def test_rounding(spark, rows):
    df = spark.createDataFrame(rows, "a bigint, b bigint").select("a", "b", *[f("a", "b").alias(m) for m, f in fx.ROUNDINGS.items()])
    for r in df.collect():
        assert [int(r[m]) for m in fx.ROUNDINGS] == [ref(r.a, r.b, m) for m in fx.ROUNDINGS]


def test_rescale_and_scales(spark):
    df = spark.range(1)
    got = df.select(
        fx.rescale(F.lit(25), 1, 0, "nearest_even"), fx.rescale(F.lit(35), 1, 0, "nearest_even"), fx.rescale(F.lit(-25), 1, 0, "floor"), fx.decimal_mul(F.lit(15), 1, F.lit(15), 1, 1),
        fx.decimal_div(F.lit(1), 0, F.lit(3), 0, 4), fx.decimal_div(F.lit(-1), 0, F.lit(3), 0, 4),
    ).first()
    assert [int(x) for x in got] == [2, 4, -3, 22, 3333, -3333]
    with pytest.raises(Exception, match="scale mismatch"):
        df.select(fx.equal_scale_add(F.lit(1), F.lit(2), F.lit(1), F.lit(3))).collect()
    assert df.select(fx.parse_at_scale(F.lit(" -1.25 "), 2)).first()[0] == Decimal(-125)
    with pytest.raises(Exception, match="not a decimal"):
        df.select(fx.parse_at_scale(F.lit("1.255"), 2)).collect()
    with pytest.raises(Exception, match="ppm"):
        df.select(fx.checked_ppm(F.lit(1_000_001))).collect()


def test_ppm_and_roots(spark):
    xs = [0, 1, 2, 3, 4, 15, 16, 10**12, 10**12 - 1, (1 << 52) + 1, 3037000499**2, 3037000499**2 - 1]
    rows = spark.createDataFrame([(x,) for x in xs], "x bigint").select("x", fx.isqrt("x").alias("r")).collect()
    assert all(r.r == isqrt(r.x) for r in rows)
    got = spark.range(1).select(fx.product_ppm(F.lit(500_000), F.lit(333_333), F.lit(999_999)), fx.scale_ppm(F.lit(-7), F.lit(500_000))).first()
    assert tuple(got) == (500_000 * 333_333 // 10**6 * 999_999 // 10**6, -3)


def logistic(z):
    y = 1700 * z
    t = s = 10**6
    for k in range(1, 9):
        t = t * abs(y) // (1000 * k)
        s += t
    e = 0 if y >= 20000 else (1 << 32) - 1 if y <= -20000 else 10**12 // s if y >= 0 else s
    return 10**12 // (10**6 + e)


def test_logistic_and_freshness(spark):
    rows = spark.range(-20, 21).select("id", fx.logistic_ppm("id").alias("p")).collect()
    assert all(r.p == logistic(r.id) for r in rows)

    def fresh(age, h):
        k = age // h
        if k >= 20:
            return 0
        v = 10**6 >> k
        return v - v * (age % h) // (2 * h)

    rows = spark.range(0, 2500, 13).select("id", fx.freshness_ppm("id", F.lit(100)).alias("p")).collect()
    assert all(r.p == fresh(r.id, 100) for r in rows)


def test_order_statistics(spark):
    df = spark.createDataFrame([(1, [5, 1, 4]), (2, [2, 8, 4, 6]), (3, [7])], "k int, v array<bigint>").withColumn("s", F.array_sort("v"))
    rows = {r.k: r for r in df.select("k", stats.lower_median("s").alias("lo"), stats.upper_median("s").alias("hi"), stats.mean_median("s").alias("m"), stats.even_median("s").alias("e")).collect()}
    assert [tuple(rows[k])[1:4] for k in (1, 2, 3)] == [(4, 4, 4), (4, 6, 5), (7, 7, 7)]
    assert [rows[k].e for k in (1, 2, 3)] == [4, 5, 7]
    halves = spark.createDataFrame([([1, 2],), ([2, 3],), ([-1, -2],), ([-3, -2],)], "s array<bigint>").select(stats.even_median(F.array_sort("s")).alias("m"))
    assert [r.m for r in halves.collect()] == [2, 2, -2, -2]


def test_effective_sample_by_hand(spark):
    series = {1: [5, 1, 4, 4, 9], 2: [7], 3: [2, 2, 2], 4: [-(10**9), 10**9, -(10**9), 0]}
    rows = [(k, i, x) for k, v in series.items() for i, x in enumerate(v)]
    out = stats.lag_moments(spark.createDataFrame(rows, "k int, i int, x long"), "k", ["i"], "x")
    got = {r.k: r for r in out.withColumn("e", stats.effective_sample_milli("n", "square_dev", "lag_products")).collect()}
    for k, v in series.items():
        mean = int(sum(v) / len(v))
        var, cov = sum((x - mean) ** 2 for x in v), sum((x - mean) * (p - mean) for p, x in zip(v, v[1:]))
        assert (got[k].mean, got[k].square_dev, got[k].lag_products) == (mean, var, cov)
        rho = min(max(int(cov * 10**6 / max(var, 1)), 0), 990_000)
        ess = min(len(v) * 1000, max(1000, len(v) * 1000 * (10**6 - rho) // (10**6 + rho)))
        assert got[k].e == (1000 if len(v) == 1 else len(v) * 1000 if not var else ess)


def test_pair_score_counts_every_pair():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 7, 8, 64, 201):
        for top in (3, 10**6):
            p, x = rng.integers(0, top, n), rng.integers(-top, top, n)
            want = sum(int(np.sign(p[i] - p[j]) * np.sign(x[i] - x[j])) for i in range(n) for j in range(i))
            assert stats.pair_score(p, x) == want
