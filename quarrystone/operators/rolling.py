"""Rolling windows, gaps, change points and other ordered folds.

Folds that only need neighbours are SQL windows; folds whose state depends on every earlier row (EWMA with rounding at
each step, CUSUM) run over one key's ordered array or in ``applyInPandas``, one key at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import half_even_div, trunc_div, wide


def count_mean(keys: list[str], order: list[str], value: str, n: int) -> Column:
    """Mean of the last ``n`` rows of the key, ties to even."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    return half_even_div(F.sum(F.col(value).cast("decimal(38,0)")).over(w), F.count(F.lit(1)).over(w)).cast("bigint")


def time_mean(keys: list[str], time: str, value: str, reach: int) -> Column:
    """Mean of the key's rows with time >= now - reach, inclusive."""
    w = Window.partitionBy(*keys).orderBy(time).rangeBetween(-reach, 0)
    return half_even_div(F.sum(F.col(value).cast("decimal(38,0)")).over(w), F.count(F.lit(1)).over(w)).cast("bigint")


def ordered(df: DataFrame, keys: list[str], order: list[str], values: list[str], out: str = "series") -> DataFrame:
    """One row per key with its rows, in order, as an array of structs."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *[v for v in values if v not in order]))).alias(out))


def ewma(series: Column, value: str, alpha_ppm: int) -> Column:
    """First value, then E(next * a) + E(prev * (1 - a)), each product rounded half to even."""
    rest = F.slice(series, F.lit(2), F.greatest(F.size(series) - 1, F.lit(0)))
    start = F.get(series, F.lit(0))[value].cast("decimal(38,0)")

    def step(acc: Column, x: Column) -> Column:
        a = half_even_div(wide(x[value]) * alpha_ppm, F.lit(1_000_000))
        b = half_even_div(acc * (1_000_000 - alpha_ppm), F.lit(1_000_000))
        return (a + b).cast("decimal(38,0)")

    return F.aggregate(rest, start, step).cast("bigint")


def islands(df: DataFrame, height: str, keys: list[str] | None = None) -> DataFrame:
    """Runs of consecutive heights: first, last, rows."""
    keys = keys or []
    w = Window.partitionBy(*keys).orderBy(height)
    run = df.select(*keys, height).distinct().withColumn("_g", F.col(height) - F.row_number().over(w))
    return run.groupBy(*keys, "_g").agg(F.min(height).alias("first"), F.max(height).alias("last"), F.count(F.lit(1)).alias("rows")).drop("_g")


def gaps(df: DataFrame, height: str, keys: list[str]) -> DataFrame:
    """Missing ranges between consecutive heights of a key."""
    nxt = F.lead(height).over(Window.partitionBy(*keys).orderBy(height))
    out = df.select(*keys, height).distinct().withColumn("_n", nxt).where(F.col("_n") - F.col(height) > 1)
    return out.select(*keys, (F.col(height) + 1).alias("gap_from"), (F.col("_n") - 1).alias("gap_to"))


def fold(df: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable[[], dict], step: Callable[[dict, dict], list[dict]]) -> DataFrame:
    """A stateful fold over each key's rows in order: ``step`` changes the state and returns rows to emit.

    The order must be total within a key (end it in an ordinal).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = start(), []
        for row in pdf.sort_values(order, kind="stable").to_dict("records"):
            out += step(state, row)
        names = {c.strip().split(" ")[0]: c.strip().split(" ")[1] for c in schema.split(",")}
        frame = pd.DataFrame(out, columns=list(names))
        return frame.astype({c: "Int64" for c, kind in names.items() if kind in ("bigint", "long")})

    return df.groupBy(*keys).applyInPandas(run, schema)


def cusum(mean_shift: int, threshold: int, least: int) -> tuple[Callable[[], dict], Callable[[dict, dict], list[dict]]]:
    """Change points of a ratio: |x - mean| beyond the drift adds up until the threshold; it never decays."""

    def start() -> dict:
        return {"regime": 0, "mean": 0, "sum": 0, "run": 0}

    def step(s: dict, row: dict) -> list[dict]:
        x = int(row["x"])
        if s["regime"] == 0:
            s.update(regime=1, mean=x, sum=0, run=0)
            return [{"key": row["key"], "ordinal": row["ordinal"], "regime": 1, "mean": x}]
        s["sum"] += max(abs(x - s["mean"]) - mean_shift, 0)
        s["run"] += 1
        if s["sum"] >= threshold and s["run"] >= least:
            s.update(regime=s["regime"] + 1, mean=x, sum=0, run=0)
            return [{"key": row["key"], "ordinal": row["ordinal"], "regime": s["regime"], "mean": x}]
        return []

    return start, step


def interpolate(points: Column, x: Column) -> Column:
    """Piecewise-linear value at x of points (x, y) sorted by x; flat outside, truncated inside."""
    first, last = F.get(points, F.lit(0)), F.get(points, F.size(points) - 1)
    lo = F.get(F.filter(points, lambda p: p["x"] <= x), F.size(F.filter(points, lambda p: p["x"] <= x)) - 1)
    hi = F.get(F.filter(points, lambda p: p["x"] > x), F.lit(0))
    mid = lo["y"] + trunc_div((hi["y"] - lo["y"]) * (x - lo["x"]), F.greatest(hi["x"] - lo["x"], F.lit(1)))
    return F.when(x <= first["x"], first["y"]).when(x >= last["x"], last["y"]).otherwise(mid)


def rows_of(pdfs: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for pdf in pdfs:
        yield from pdf.to_dict("records")
