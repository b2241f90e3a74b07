"""Exact integer, decimal and ppm expressions.

Everything is BIGINT or DECIMAL under ANSI mode, so overflow raises instead of wrapping.  ``div`` is only used on
BIGINT: on decimals it returns BIGINT and wraps.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PPM = 1_000_000


def col(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(x))


def big(x) -> Column:
    return col(x).cast("bigint")


def wide(x) -> Column:
    return col(x).cast("decimal(38,0)")


def trunc_div(a, b) -> Column:
    """a / b toward zero on BIGINT."""
    return F.call_function("div", big(a), big(b))


def trunc_wide(a, b) -> Column:
    """a / b toward zero on DECIMAL(38,0): exact because the dividend is made divisible first."""
    a, b = wide(a), wide(b)
    return ((a - a % b) / b).cast("decimal(38,0)")


def floor_div(a, b) -> Column:
    a, b = wide(a), wide(b)
    a, b = F.when(b < 0, -a).otherwise(a), F.abs(b)
    return ((a - F.pmod(a, b)) / b).cast("decimal(38,0)")


def ceil_div(a, b) -> Column:
    return -floor_div(-wide(a), b)


def half_even_div(a, b) -> Column:
    """a / b rounded to the nearest integer, ties to even, from quotient and remainder."""
    a, b = wide(a), wide(b)
    q, r = trunc_wide(a, b), a % b
    twice, size = F.abs(r) * 2, F.abs(b)
    up = (twice > size) | ((twice == size) & (q % 2 != 0))
    sign = F.when((a < 0) != (b < 0), -1).otherwise(1)
    return (q + F.when(up, sign).otherwise(0)).cast("decimal(38,0)")


ROUNDINGS = {"toward_zero": trunc_wide, "floor": floor_div, "ceiling": ceil_div, "nearest_even": half_even_div}


def decimal_mul(a, sa: int, b, sb: int, out: int, rounding: str = "toward_zero") -> Column:
    """Product of raw values of scales sa, sb at scale ``out``."""
    return rescale(wide(a) * wide(b), sa + sb, out, rounding)


def decimal_div(a, sa: int, b, sb: int, out: int, rounding: str = "toward_zero") -> Column:
    shift = out + sb - sa
    num, den = wide(a), wide(b)
    if shift >= 0:
        return ROUNDINGS[rounding](num * F.lit(10**shift).cast("decimal(38,0)"), den)
    return ROUNDINGS[rounding](num, den * F.lit(10**-shift).cast("decimal(38,0)"))


def rescale(raw, scale: int, out: int, rounding: str = "toward_zero") -> Column:
    if out >= scale:
        return (wide(raw) * F.lit(10 ** (out - scale)).cast("decimal(38,0)")).cast("decimal(38,0)")
    return ROUNDINGS[rounding](raw, F.lit(10 ** (scale - out)))


def equal_scale_add(a, sa, b, sb) -> Column:
    """a + b where the scales are equal, an error otherwise."""
    return F.when(col(sa) == col(sb), wide(a) + wide(b)).otherwise(F.raise_error(F.lit("scale mismatch")).cast("decimal(38,0)"))


def parse_at_scale(text, scale: int) -> Column:
    """Raw value of a decimal text at ``scale``; more digits than the scale holds are an error, not a rounding."""
    t = F.trim(col(text))
    ok = F.regexp_like(t, F.lit(rf"^[+-]?\d+(\.\d{{0,{scale}}})?$" if scale else r"^[+-]?\d+$"))
    value = (t.cast(f"decimal(38,{scale})") * F.lit(10**scale).cast("decimal(20,0)")).cast("decimal(38,0)")
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit("not a decimal of this scale: "), t)).cast("decimal(38,0)"))


def checked_ppm(x) -> Column:
    return F.when(col(x).between(0, PPM), big(x)).otherwise(F.raise_error(F.lit("ppm out of range")).cast("bigint"))


def scale_ppm(value, ppm) -> Column:
    """value * ppm / 1e6 toward zero."""
    return trunc_wide(wide(value) * wide(ppm), F.lit(PPM)).cast("bigint")


def product_ppm(*factors) -> Column:
    """Product of ppm factors, truncated after each one."""
    out = big(factors[0])
    for f in factors[1:]:
        out = trunc_div(out * big(f), F.lit(PPM))
    return out


def clamp(x, low, high) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def isqrt(x) -> Column:
    """Integer square root of a non-negative BIGINT: the double root, corrected."""
    r = F.floor(F.sqrt(big(x).cast("double"))).cast("bigint")
    r = F.when(wide(r) * wide(r) > wide(x), r - 1).otherwise(r)
    return F.when(wide(r + 1) * wide(r + 1) <= wide(x), r + 1).otherwise(r)


def exp_series(milli) -> Column:
    """Eight-term integer series of exp(milli / 1000) at 1e6, each term truncated."""
    step = F.sequence(F.lit(1), F.lit(8))
    start = F.struct(F.lit(PPM).cast("decimal(38,0)").alias("t"), F.lit(PPM).cast("decimal(38,0)").alias("s"))

    def add(acc: Column, k: Column) -> Column:
        t = trunc_wide(acc["t"] * wide(milli), wide(k) * 1000)
        return F.struct(t.alias("t"), (acc["s"] + t).cast("decimal(38,0)").alias("s"))

    return F.aggregate(step, start, add, lambda a: a["s"])


def logistic_ppm(z_milli) -> Column:
    """Logistic of z with slope 1700 per unit, without the division by 1000: it saturates from |z| = 12 on."""
    y = big(z_milli) * 1700
    s = exp_series(F.abs(y))
    e = F.when(y >= 20000, F.lit(0).cast("decimal(38,0)")).when(y <= -20000, F.lit((1 << 32) - 1).cast("decimal(38,0)"))
    e = e.when(y >= 0, trunc_wide(F.lit(PPM * PPM), s)).otherwise(s)
    return trunc_wide(F.lit(PPM * PPM), e + PPM).cast("bigint")


def freshness_ppm(age, half_life) -> Column:
    """Halves every half-life, linear in between, zero from twenty half-lives on."""
    k = trunc_div(age, half_life)
    v = F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(PPM).cast("bigint"), lambda a, i: F.when(i <= k, trunc_div(a, F.lit(2))).otherwise(a))
    return F.when(k >= 20, F.lit(0).cast("bigint")).otherwise(v - trunc_wide(wide(v) * wide(big(age) % big(half_life)), wide(big(half_life)) * 2).cast("bigint"))


def aligned(value, unit, value_scale: int, unit_scale: int) -> Column:
    """Whether a raw value is a whole number of units, both brought to the larger scale; no unit, no alignment."""
    scale = max(value_scale, unit_scale)
    v, u = wide(value) * 10 ** (scale - value_scale), wide(unit) * 10 ** (scale - unit_scale)
    return F.coalesce((wide(unit) > 0) & (v % F.when(u > 0, u) == 0), F.lit(False))


def percent_encoded(c) -> Column:
    """Every UTF-8 byte but letters, digits and ``._-`` as ``%XX``."""
    pairs = F.regexp_extract_all(F.hex(F.encode(col(c), "UTF-8")), F.lit("[0-9A-F]{2}"), F.lit(0))
    plain = "^(?:2[DE]|3[0-9]|4[1-9A-F]|5[0-9A]|5F|6[1-9A-F]|7[0-9A])$"
    return F.array_join(F.transform(pairs, lambda x: F.when(F.regexp_like(x, F.lit(plain)), F.decode(F.unhex(x), "UTF-8")).otherwise(F.concat(F.lit("%"), x))), "")


def hour_partition(us) -> Column:
    return F.date_format(F.timestamp_micros(big(us)), "yyyy-MM-dd/HH")


def framed_digest(*parts) -> Column:
    """SHA-256 of the parts, each behind its length: no two part lists share an encoding."""
    texts = [F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat(*[F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]), 256)
