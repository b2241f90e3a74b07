"""Execution simulation of one signal against later books, all in integers; margin models with exact prices."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def trunc(a: int, b: int) -> int:
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


def splitmix64(seed: int) -> int:
    """One output of SplitMix64; wraps at 64 bits."""
    m = (1 << 64) - 1
    z = (seed + 0x9E3779B97F4A7C15) & m
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & m
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
    return z ^ (z >> 31)


def select_book(books: list[dict], at: int, known: int) -> dict | None:
    """Latest visible book; the last of equal ones."""
    best = None
    for b in books:
        if b["effective"] <= at and b["known"] <= known and (best is None or (b["effective"], b["known"]) >= (best["effective"], best["known"])):
            best = b
    return best


def walk(levels: list[tuple[int, int]], want: int, limit: int | None, buy: bool, share_ppm: int = 1_000_000) -> tuple[int, int]:
    """Filled quantity and notional over levels within the limit; ``share_ppm`` is the part of each that is ours."""
    filled = paid = 0
    for price, size in levels:
        if limit is not None and (price > limit if buy else price < limit):
            break
        take = min(want - filled, trunc(size * share_ppm, 1_000_000))
        filled, paid = filled + take, paid + take * price
        if filled == want:
            break
    return filled, paid


def simulate(r: dict, books: list[dict]) -> dict:
    """One request: arrive after the latency, fill by policy, exit at the earliest cause, subtract costs.

    ``r``: id, buy, detected, known, latency, stale, quantity, part_ppm, bankroll, policy (Market, IOC, GTC, ALO),
    limit, hold, take_profit, stop, fee_ppm, slip_bps, impact_bps, funding_every, funding_ppm.  ``books``: effective,
    known, bids, asks as (price, quantity) best first.  The spread cost is reported and not deducted.
    """
    none = {"id": r["id"], "status": None, "filled": 0, "entry": 0, "exit": 0, "cause": None, "fees": 0, "slippage": 0, "impact": 0, "funding": 0, "spread": 0, "net": 0}
    arrival = r["detected"] + r["latency"]
    book = select_book(books, arrival, r["known"])
    if book is None or arrival - book["effective"] > r["stale"]:
        return none | {"status": "StaleBook"}
    near, far = (book["asks"], book["bids"]) if r["buy"] else (book["bids"], book["asks"])
    depth = sum(q for _, q in near)
    want = min(r["quantity"], trunc(depth * r["part_ppm"], 1_000_000))
    if not near or not far or want <= 0:
        return none | {"status": "NoDepth"}
    if near[-1][0] * want > r["bankroll"]:
        return none | {"status": "Bankroll"}
    crosses = r["limit"] is None or (near[0][0] <= r["limit"] if r["buy"] else near[0][0] >= r["limit"])
    if r["policy"] == "ALO" and crosses:
        return none | {"status": "WouldCross"}
    limit = None if r["policy"] == "Market" else r["limit"]
    filled, paid = walk(near, want, limit, r["buy"]) if r["policy"] != "ALO" else (0, 0)
    later = sorted((b for b in books if b["effective"] > arrival and b["known"] <= r["known"]), key=lambda b: b["effective"])
    if r["policy"] in ("GTC", "ALO") and filled < want:
        for b in later:
            if b["effective"] > arrival + r["hold"] or filled == want:
                break
            side = b["asks"] if r["buy"] else b["bids"]
            got, cost = walk(side, want - filled, r["limit"], r["buy"], 500_000)
            filled, paid = filled + got, paid + cost
    if not filled:
        return none | {"status": "Unfilled"}
    cause, at, out = "Time", arrival + r["hold"], None
    for b in later:
        if b["effective"] >= at:
            break
        price = (b["bids"] if r["buy"] else b["asks"])[0][0]
        up = price if r["buy"] else -price
        hit = "TakeProfit" if r["take_profit"] is not None and up >= (r["take_profit"] if r["buy"] else -r["take_profit"]) else None
        hit = hit or ("Stop" if r["stop"] is not None and up <= (r["stop"] if r["buy"] else -r["stop"]) else None)
        if hit:
            cause, at, out = hit, b["effective"], b
            break
    out = out or select_book(books, at, r["known"])
    closing = (out["bids"] if r["buy"] else out["asks"]) or far
    done, got = walk(closing, filled, None, not r["buy"])
    if done < filled:
        got += (filled - done) * closing[-1][0]
    fees = trunc((paid + got) * r["fee_ppm"], 1_000_000)
    slip = trunc((paid + got) * r["slip_bps"], 10_000)
    impact = trunc(paid * trunc(r["impact_bps"] * filled, max(depth, 1)), 10_000)
    funding = (at - arrival) // r["funding_every"] * trunc(paid * r["funding_ppm"], 1_000_000) * (1 if r["buy"] else -1)
    spread = abs(2 * paid - (near[0][0] + far[0][0]) * filled) // 2
    gross = got - paid if r["buy"] else paid - got
    return none | {
        "status": "Filled" if filled == want else "Partial", "filled": filled, "entry": paid, "exit": got, "cause": cause, "fees": fees, "slippage": slip,
        "impact": impact, "funding": funding, "spread": spread, "net": gross - fees - slip - impact - funding,
    }


RESULT = "id bigint, status string, filled bigint, entry bigint, exit bigint, cause string, fees bigint, slippage bigint, impact bigint, funding bigint, spread bigint, net bigint"


def run(requests: DataFrame) -> DataFrame:
    """Simulate rows of (request struct, books array): each row holds its own books, so rows are independent."""

    def each(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in RESULT.split(", ")]
        for pdf in pdfs:
            out = []
            for r, books in zip(pdf["request"], pdf["books"]):
                own = [{"effective": int(b["effective"]), "known": int(b["known"]), **{s: [(int(x["price"]), int(x["quantity"])) for x in b[s]] for s in ("bids", "asks")}} for b in books]
                out.append(simulate({k: (int(v) if isinstance(v, float) else v) for k, v in dict(r).items()}, own))
            yield pd.DataFrame(out, columns=names)

    return requests.mapInPandas(each, RESULT)


def liquidation(collateral: int, oracle: int, maintenance: int) -> tuple[str, int, int]:
    """Exact price, or a range where the quotient is not exact."""
    if maintenance == 0:
        return ("NotApplicable", 0, 0)
    if collateral * oracle % maintenance:
        return ("Range", oracle, oracle)
    p = collateral * oracle // maintenance
    return ("Exact", p, p)
