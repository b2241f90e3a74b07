"""Order-book fold and exact execution quotes.

One market's diffs are a sequence whose state is the whole book, so the fold runs per market; many markets run at once.
"""

from __future__ import annotations

import hashlib
import json
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame

from .rolling import fold

STATE = "market string, ordinal bigint, sequence bigint, health string, best_bid bigint, best_ask bigint, orders bigint, reason string"


class Side:
    """Price levels of one side: size and count by price, and a heap of prices whose emptied levels go when met."""

    def __init__(self, bids: bool) -> None:
        self.sign = -1 if bids else 1
        self.sizes: dict[int, list[int]] = {}
        self.heap: list[int] = []

    def change(self, price: int, quantity: int, orders: int) -> None:
        level = self.sizes.get(price)
        if level is None:
            level = self.sizes[price] = [0, 0]
            heappush(self.heap, self.sign * price)
        level[0] += quantity
        level[1] += orders
        if not level[1]:
            del self.sizes[price]

    def best(self) -> int | None:
        while self.heap and self.sign * self.heap[0] not in self.sizes:
            heappop(self.heap)
        return self.sign * self.heap[0] if self.heap else None


class Book:
    """Price-time priority book of integers.  A broken rule turns it Red and clears it until the next snapshot."""

    def __init__(self, most: int = 1_048_576) -> None:
        self.most = most
        self.sequence, self.opening = None, False
        self.red("NoSnapshot")

    def _clear(self) -> None:
        self.orders: dict[str, dict] = {}
        self.sides = {True: Side(True), False: Side(False)}

    def red(self, reason: str) -> None:
        self._clear()
        self.health, self.reason = "Red", reason

    def _count(self, o: dict, sign: int) -> None:
        if not o.get("trigger"):
            self.sides[o["bid"]].change(o["price"], sign * o["remaining"], sign)

    def _insert(self, o: dict) -> None:
        if o["order_id"] in self.orders:
            return self.red("DuplicateOrder")
        if o["price"] <= 0 or o["remaining"] <= 0:
            return self.red("NonPositive")
        if len(self.orders) >= self.most:
            return self.red("OrderCap")
        self.orders[o["order_id"]] = dict(o)
        self._count(o, 1)

    def _remove(self, order_id: str) -> dict:
        o = self.orders.pop(order_id)
        self._count(o, -1)
        return o

    def begin(self, sequence: int) -> None:
        """Open a snapshot; its orders follow, and ``finish`` ends it."""
        self._clear()
        self.sequence, self.health, self.reason, self.opening = sequence, "Healthy", None, True

    def load(self, order: dict) -> None:
        if self.health == "Healthy":
            self._insert(order)

    def finish(self) -> None:
        self.opening = False
        self._check()

    def snapshot(self, sequence: int, orders: list[dict]) -> None:
        self.begin(sequence)
        for o in orders:
            self.load(o)
        self.finish()

    def diff(self, sequence: int, kind: str, order: dict) -> None:
        if self.opening:
            self.finish()
        if self.health != "Healthy":
            return
        if sequence != self.sequence + 1:
            return self.red("SequenceGap")
        self.sequence = sequence
        if kind == "Add":
            self._insert(order)
        elif order["order_id"] not in self.orders:
            return self.red("UnknownOrder")
        elif kind == "Cancel":
            self._remove(order["order_id"])
        elif kind == "Fill":
            o = self._remove(order["order_id"])
            left = o["remaining"] - order["quantity"]
            if order["quantity"] <= 0 or left < 0:
                return self.red("Overfill")
            if left:
                self._insert(o | {"remaining": left})
        elif kind == "Update":  # a new price and size; keeps its time
            if order["remaining"] < 0 or order["price"] <= 0:
                return self.red("NonPositive")
            o = self._remove(order["order_id"])
            if order["remaining"]:
                self._insert(o | {"remaining": order["remaining"], "price": order["price"]})
        if self.health == "Healthy":
            self._check()

    def live(self, bids: bool) -> list[dict]:
        side = [o for o in self.orders.values() if o["bid"] == bids and not o.get("trigger")]
        return sorted(side, key=lambda o: (-o["price"] if bids else o["price"], o["time"], o["order_id"]))

    def best(self, bids: bool) -> int | None:
        return self.sides[bids].best()

    def crossed(self) -> bool:
        bid, ask = self.best(True), self.best(False)
        return bid is not None and ask is not None and bid >= ask

    def _check(self) -> None:
        if self.crossed():
            self.red("Crossed")

    def levels(self, bids: bool) -> list[tuple[int, int, int]]:
        return [(p, *self.sides[bids].sizes[p]) for p in sorted(self.sides[bids].sizes, reverse=bids)]


class CommittedBook:
    """A book fed by committed messages with ids: a repeat of the same content changes nothing, another content under a
    known id is a conflict.  Provisional ids are only remembered, up to a bound."""

    def __init__(self, book: Book | None = None, most_provisional: int = 4096) -> None:
        self.book, self.most = book or Book(), most_provisional
        self.done: dict[str, str] = {}
        self.open: dict[str, str] = {}

    def _known(self, ids: dict[str, str], name: str, digest: str) -> bool:
        if name in ids and ids[name] != digest:
            raise ValueError(f"conflict under id {name}")
        return name in ids

    def commit(self, name: str, sequence: int, kind: str, content: dict | list[dict]) -> None:
        """Apply a diff, or a Snapshot whose content is a list of orders; a book that turns Red refuses."""
        digest = content_digest([sequence, kind, content])
        if not self._known(self.done, name, digest):
            if kind == "Snapshot":
                self.book.snapshot(sequence, content)
            else:
                self.book.diff(sequence, kind, content)
        if self.book.health != "Healthy":
            raise ValueError(f"book is {self.book.health}: {self.book.reason}")
        self.done[name] = digest
        self.open.pop(name, None)

    def provisional(self, name: str, digest: str) -> None:
        if not self._known(self.open, name, digest):
            if len(self.open) >= self.most:
                raise ValueError("too many unmatched provisional ids")
            self.open[name] = digest


def content_digest(content) -> str:
    return hashlib.sha256(json.dumps(content, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def checkpoint(book: Book) -> dict:
    """The whole state of a healthy book with its digest; orders by id."""
    if book.health != "Healthy":
        raise ValueError("only a healthy book has a checkpoint")
    state = {"sequence": book.sequence, "most": book.most, "orders": [book.orders[k] for k in sorted(book.orders)]}
    return state | {"digest": content_digest(state)}


def restored(state: dict) -> Book:
    """The book of a checkpoint; a digest that does not match its state raises."""
    book = Book(state["most"])
    book.snapshot(state["sequence"], state["orders"])
    if checkpoint(book)["digest"] != state["digest"]:
        raise ValueError("the checkpoint's digest does not match its state")
    return book


def exact_div(a: int, b: int) -> int:
    if b == 0 or a % b:
        raise ArithmeticError("not exact")
    return a // b


def quote(book: Book, buy: bool, quantity: int) -> dict:
    """Walk the opposite side for ``quantity``: every figure is exact, or it is an error."""
    if book.health != "Healthy":
        raise ValueError("book is not healthy")
    need, paid, used = quantity, 0, 0
    for price, size, _ in book.levels(not buy):
        take = min(need, size)
        paid, need, used = paid + take * price, need - take, used + 1
        if not need:
            break
    if need:
        raise ValueError("insufficient depth")
    bid, ask = book.levels(True), book.levels(False)
    vwap = exact_div(paid, quantity)
    out = {"vwap": vwap, "notional": paid, "levels": used, "worst": price}
    if bid and ask:
        b, a = bid[0][0], ask[0][0]
        out |= {"spread_bps": exact_div((a - b) * 20_000, a + b), "impact_bps": exact_div((2 * vwap - (a + b)) * 10_000, a + b)}
    return out


def replay(diffs: DataFrame) -> DataFrame:
    """Book state after each op of diffs(market, ordinal, sequence, kind, order_id, bid, price, remaining, quantity, time).

    Rows of kind Snapshot with one ordinal are one snapshot.
    """

    def start() -> dict:
        return {"book": Book()}

    def step(s: dict, r: dict) -> list[dict]:
        o = {k: (None if pd.isna(r[k]) else r[k]) for k in ("order_id", "bid", "price", "remaining", "quantity", "time")}
        b = s["book"]
        if r["kind"] == "Snapshot":
            if not b.opening or b.sequence != r["sequence"]:
                b.begin(int(r["sequence"]))
            b.load(o)
        else:
            b.diff(int(r["sequence"]), r["kind"], o)
        crossed = b.opening and b.crossed()  # an unfinished snapshot shows what it would be as it stands
        return [
            {
                "market": r["market"], "ordinal": int(r["ordinal"]), "sequence": int(r["sequence"]), "health": "Red" if crossed else b.health,
                "best_bid": None if crossed else b.best(True), "best_ask": None if crossed else b.best(False), "orders": 0 if crossed else len(b.orders),
                "reason": "Crossed" if crossed else b.reason,
            }
        ]

    return fold(diffs, ["market"], ["ordinal", "order_id"], STATE, start, step)
