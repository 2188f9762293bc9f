"""What truly depends on its own output: books, queues and the execution of a parent order.

Plain Python state machines, fed in time order. ``per_key`` runs one per key over sorted
partitions, so a key's events stream through and never gather in memory.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class BookError(ValueError):
    pass


class PriceBook:
    """Sizes by price level. ``strict`` raises on what a book can't do, else it is clamped and counted
    and ``hook(code, text)`` is told. A locked market is counted too, and raises with ``strict_locked``
    alone. ``max_levels`` of a side; prices outside ``band`` are faults and left out."""

    def __init__(self, strict: bool = True, strict_locked: bool = False, max_levels: int | None = None, band: tuple[int, int] | None = None, hook=None) -> None:
        self.sides: dict[str, dict[int, int]] = {"BUY": {}, "SELL": {}}
        self.strict, self.strict_locked, self.max_levels, self.band, self.hook = strict, strict_locked, max_levels, band, hook
        self.violations = self.crossed = self.locked = self.updates = self.trades = self.traded = 0

    def _fault(self, text: str, code: str = "depth", strict: bool | None = None) -> None:
        self.violations += 1
        if self.hook is not None:
            self.hook(code, text)
        if self.strict if strict is None else strict:
            raise BookError(text)

    def _take(self, side: str, price: int, qty: int) -> None:
        level = self.sides[side]
        have = level.get(price, 0)
        if qty > have:
            self._fault(f"{qty} taken of {have} at {price}")
            qty = have
        self.taken = qty
        if have - qty > 0:
            level[price] = have - qty
        else:
            level.pop(price, None)

    def apply(self, kind: str, side: str | None, price: int | None, qty: int | None) -> None:
        """ADD, CANCEL, SNAPSHOT (absolute), CLEAR; TRADE with the aggressor's side takes the other."""
        if kind == "CLEAR":
            self.sides = {"BUY": {}, "SELL": {}}
            return
        if kind in ("HALT", "RESUME"):
            return
        if kind in ("MODIFY", "REPLACE"):
            raise BookError(f"{kind} needs order ids")
        if price is None or qty is None or qty <= 0:
            raise BookError(f"{kind} needs a price and a positive quantity")
        if self.band is not None and not self.band[0] <= price <= self.band[1]:
            self._fault(f"price {price} outside {self.band}", "band")
            return
        if kind in ("ADD", "SNAPSHOT") and side is not None and price not in self.sides[side] and len(self.sides[side]) == self.max_levels:
            raise BookError(f"more than {self.max_levels} levels")
        self.updates += kind != "TRADE"
        if kind == "TRADE":
            if side is None:
                self._fault("trade without aggressor", "aggressor")
                return
            self._take("SELL" if side == "BUY" else "BUY", price, qty)
            self.trades, self.traded = self.trades + 1, self.traded + self.taken
        elif side is None:
            raise BookError(f"{kind} needs a side")
        elif kind == "ADD":
            self.sides[side][price] = self.sides[side].get(price, 0) + qty
        elif kind == "CANCEL":
            self._take(side, price, qty)
        elif kind == "SNAPSHOT":
            self.sides[side][price] = qty
        else:
            raise BookError(f"unknown event {kind}")
        bid, ask = self.best("BUY"), self.best("SELL")
        if bid is not None and ask is not None and bid >= ask:
            if bid > ask:
                self.crossed += 1
                self._fault(f"crossed: {bid} > {ask}", "crossed")
            else:
                self.locked += 1
                if self.strict_locked:
                    self._fault(f"locked at {bid}", "locked", True)
                elif self.hook is not None:
                    self.hook("locked", f"locked at {bid}")

    def best(self, side: str) -> int | None:
        level = self.sides[side]
        return (max if side == "BUY" else min)(level) if level else None

    def top(self, side: str, n: int) -> list[tuple[int, int]]:
        level = self.sides[side]
        return [(p, level[p]) for p in sorted(level, reverse=side == "BUY")[:n]]


def book_for(tier: str, **options) -> "PriceBook | OrderBook":
    """The book that data of a tier can keep: by level, or by order; the touch alone keeps none."""
    if tier == "L2_MBP":
        return PriceBook(**options)
    if tier == "L3_MBO":
        return OrderBook()
    raise PermissionError(f"{tier} data hold no book")


class OrderBook:
    """Orders by id, first in first out at each level."""

    def __init__(self) -> None:
        self.orders: dict[int, tuple[str, int]] = {}
        self.queues: dict[tuple[str, int], dict[int, int]] = {}

    def add(self, order_id: int, side: str, price: int, qty: int) -> None:
        if order_id in self.orders:
            raise BookError(f"order {order_id} is there already")
        self.orders[order_id] = (side, price)
        self.queues.setdefault((side, price), {})[order_id] = qty

    def cancel(self, order_id: int, qty: int | None = None) -> int:
        """Cancel part or (None) all; what was taken."""
        if order_id not in self.orders:
            raise BookError(f"no order {order_id}")
        key = self.orders[order_id]
        have = self.queues[key][order_id]
        gone = have if qty is None else qty
        if gone > have:
            raise BookError(f"{gone} cancelled of {have}")
        self._set(order_id, have - gone)
        return gone

    def modify(self, order_id: int, qty: int, keep: bool = True) -> None:
        """A new size: a smaller one keeps its place if it may; else the order goes to the back."""
        if order_id not in self.orders:
            raise BookError(f"no order {order_id}")
        side, price = self.orders[order_id]
        queue = self.queues[side, price]
        if qty > queue[order_id] or not keep and 0 < qty < queue[order_id]:
            del queue[order_id]
            queue[order_id] = qty
        else:
            self._set(order_id, qty)

    def replace(self, order_id: int, price: int, qty: int) -> None:
        if order_id not in self.orders:
            raise BookError(f"no order {order_id}")
        side, _ = self.orders[order_id]
        self.cancel(order_id)
        self.add(order_id, side, price, qty)

    def trade(self, resting_side: str, price: int, qty: int) -> list[tuple[int, int]]:
        """Executes from the front of a level: (order, quantity)."""
        out = []
        while qty:
            queue = self.queues.get((resting_side, price))
            if not queue:
                raise BookError(f"{qty} more traded than rests at {price}")
            order_id, have = next(iter(queue.items()))
            take = min(have, qty)
            self._set(order_id, have - take)
            out.append((order_id, take))
            qty -= take
        return out

    def ahead(self, order_id: int) -> int:
        total = 0
        for other, qty in self.queues[self.orders[order_id]].items():
            if other == order_id:
                return total
            total += qty
        return total

    def _set(self, order_id: int, qty: int) -> None:
        key = self.orders[order_id]
        if qty:
            self.queues[key][order_id] = qty
            return
        del self.queues[key][order_id], self.orders[order_id]
        if not self.queues[key]:
            del self.queues[key]


@dataclass
class QueuePlace:
    """Our order behind what rested before it. Cancels ahead of it: none (optimistic), all
    (conservative) or the share of the level that stands ahead (neutral)."""

    side: str
    price: int
    remaining: int
    ahead: int
    since: int = 0

    def trade(self, qty: int) -> int:
        used = min(self.ahead, qty)
        self.ahead -= used
        fill = min(self.remaining, qty - used)
        self.remaining -= fill
        return fill

    def cancelled(self, qty: int, level: int, policy: str) -> None:
        if policy == "neutral":
            qty = int(qty * min(max(self.ahead / level, 0.0), 1.0)) if level > 0 else 0
        elif policy == "optimistic":
            qty = 0
        elif policy != "conservative":
            raise ValueError(f"unknown cancel policy {policy!r}")
        self.ahead -= min(self.ahead, qty)


class ExactQueue:
    """Our order behind orders known by id. An execution that names one of them shrinks it; one that
    names another reaches us only when nothing is ahead; one that names none works from the front."""

    def __init__(self, side: str, price: int, qty: int, ahead: list[tuple[int, int]]) -> None:
        self.side, self.price, self.remaining = side, price, qty
        self.orders = dict(ahead)

    @property
    def ahead(self) -> int:
        return sum(self.orders.values())

    def _reach(self, qty: int) -> int:
        fill = min(self.remaining, qty)
        self.remaining -= fill
        return fill

    def _shrink(self, order_id: int, qty: int) -> int:
        gone = min(self.orders[order_id], qty)
        self.orders[order_id] -= gone
        if not self.orders[order_id]:
            del self.orders[order_id]
        return gone

    def trade(self, qty: int, order_id: int | None = None) -> int:
        """What of the execution fills us."""
        if order_id is not None:
            if order_id in self.orders:
                self._shrink(order_id, qty)
                return 0
            return 0 if self.orders else self._reach(qty)
        while self.orders and qty > 0:
            qty -= self._shrink(next(iter(self.orders)), qty)
        return self._reach(qty) if not self.orders and qty > 0 else 0

    def cancelled(self, qty: int, order_id: int | None) -> None:
        if order_id is None:
            raise PermissionError("an exact queue needs the id of the order that is cancelled")
        if order_id in self.orders:
            self._shrink(order_id, qty)


def queue_place(mode: str, side: str, price: int, qty: int, level: int = 0, ahead: list[tuple[int, int]] | None = None):
    """An approximate place behind a level's size, or an exact one behind known orders."""
    if mode == "APPROXIMATE":
        return QueuePlace(side, price, qty, max(level, 0))
    if mode == "EXACT":
        if ahead is None:
            raise PermissionError("an exact queue needs orders by id")
        return ExactQueue(side, price, qty, ahead)
    raise ValueError(f"mode must be APPROXIMATE or EXACT, not {mode!r}")


def weights(policy: str, slices: int, profile: list[float] | None = None, kappa: float = 0.02) -> list[float]:
    """Shares of a parent order by slice; profile: an earlier session's volume shares."""
    if policy == "twap":
        return [1 / slices] * slices
    if policy == "vwap":
        if not profile:
            raise ValueError("vwap needs a profile of earlier sessions")
        n, total = len(profile), sum(profile) or 1.0
        out = []
        for k in range(slices):
            a, b = k * n / slices, (k + 1) * n / slices
            out.append(sum(profile[j] * max(0.0, min(b, j + 1) - max(a, j)) for j in range(n)) / total)
        return out
    if policy == "is":
        left = lambda k: (slices - k) / slices if kappa < 1e-9 else math.exp(-kappa * k) if kappa * slices > 50 else math.sinh(kappa * (slices - k)) / math.sinh(kappa * slices)
        steps = [left(k) - left(k + 1) for k in range(slices)]
        return [s / sum(steps) for s in steps]
    raise ValueError(f"unknown schedule {policy!r}")


@dataclass
class Parent:
    side: str
    quantity: int
    start: int
    end: int
    policy: str = "twap"
    style: str = "aggressive"
    slices: int = 10
    latency: int = 0
    rate: float = 0.05
    interval: int = 60_000_000_000
    timeout: int = 30_000_000_000
    cancel_policy: str = "conservative"
    profile: list[float] = field(default_factory=list)


class Execution:
    """One parent order over one event stream: schedule, arrival after latency, fills, sweep at the end.

    Aggressive children walk the opposite side when they arrive; passive ones join their own touch
    behind its size, fill from trades, are cancelled after ``timeout`` and then sent aggressively.
    The end of the window cancels what rests and sweeps what is left. Our fills don't move the book.
    """

    def __init__(self, parent: Parent) -> None:
        self.p, self.book = parent, PriceBook(strict=False)
        self.resting: list[QueuePlace] = []
        self.due: list[tuple[int, int, int, bool]] = []  # arrival, order, quantity, aggressive
        self.fills: list[tuple[int, int, int, str]] = []  # time, price, quantity, liquidity
        self.filled = self.working = self.sent = self.volume = self.seen = 0
        self.next = 0
        self.pov_at, self.pov_volume, self.closed = parent.start, 0, False
        self.targets: list[int] = []
        self.arrival2 = self.terminal2 = None
        if parent.policy != "pov":
            total = 0.0
            for w in weights(parent.policy, parent.slices, parent.profile):
                total += w
                self.targets.append(round(parent.quantity * total))
            self.targets[-1] = parent.quantity

    def _opposite(self) -> str:
        return "SELL" if self.p.side == "BUY" else "BUY"

    def _fill(self, t: int, price: int, qty: int, liquidity: str) -> None:
        self.fills.append((t, price, qty, liquidity))
        self.filled += qty
        self.working -= qty

    def _send(self, t: int, qty: int, aggressive: bool) -> None:
        qty = min(qty, self.p.quantity - self.filled - self.working)
        if qty > 0:
            self.working += qty
            self.sent += 1
            heapq.heappush(self.due, (t + self.p.latency, self.sent, qty, aggressive))

    def _arrive(self, t: int) -> None:
        while self.due and self.due[0][0] <= t:
            at, _, qty, aggressive = heapq.heappop(self.due)
            touch = self.book.best(self.p.side)
            if aggressive or touch is None:
                for price, size in self.book.top(self._opposite(), len(self.book.sides[self._opposite()])):
                    take = min(size, qty)
                    if take:
                        self._fill(at, price, take, "TAKER")
                        qty -= take
                self.working -= qty  # what found nothing
            else:
                self.resting.append(QueuePlace(self.p.side, touch, qty, self.book.sides[self.p.side][touch], at))

    def event(self, t: int, kind: str, side: str | None, price: int | None, qty: int | None) -> None:
        p = self.p
        if t > p.end and not self.closed:
            self._close()
        self._arrive(t)
        if p.start <= t <= p.end and not self.closed:
            if kind == "TRADE" and side is not None:
                self.volume += qty or 0
                left = qty or 0
                for place in self.resting:
                    if place.side != side and place.price == price and left > 0:
                        before = place.ahead + place.remaining
                        got = place.trade(left)
                        left -= before - place.ahead - place.remaining
                        if got:
                            self._fill(t, place.price, got, "MAKER")
            elif kind == "CANCEL":
                for place in self.resting:
                    if place.side == side and place.price == price:
                        place.cancelled(qty or 0, self.book.sides[side].get(price, 0), p.cancel_policy)
            elif kind == "CLEAR":
                self.working -= sum(x.remaining for x in self.resting)
                self.resting = []
            self.resting = [x for x in self.resting if x.remaining]
        self.book.apply(kind, side, price, qty)
        bid, ask = self.book.best("BUY"), self.book.best("SELL")
        if p.start <= t <= p.end and not self.closed:
            if bid is not None and ask is not None:
                self.arrival2 = bid + ask if self.arrival2 is None else self.arrival2
                self.terminal2 = bid + ask
            if t >= p.end:
                self._close()
                return
            late = [x for x in self.resting if t - x.since >= p.timeout]
            self.resting = [x for x in self.resting if t - x.since < p.timeout]
            for x in late:
                self.working -= x.remaining
                self._send(t, x.remaining, True)
            self._decide(t)
            self._arrive(t)

    def _decide(self, t: int) -> None:
        p = self.p
        aggressive = p.style == "aggressive"
        if p.policy == "pov":
            if t >= self.pov_at + p.interval:
                self._send(t, round(p.rate * (self.volume - self.pov_volume)), aggressive)
                self.pov_at, self.pov_volume = t, self.volume
            return
        while self.next < p.slices and t >= p.start + round((p.end - p.start) * (self.next + 1) / p.slices):
            self.next += 1
            self._send(t, self.targets[self.next - 1] - self.filled - self.working, aggressive)

    def _close(self) -> None:
        self.closed = True
        self.working -= sum(x.remaining for x in self.resting) + sum(q for _, _, q, _ in self.due)
        self.resting, self.due = [], []
        left = self.p.quantity - self.filled
        if left > 0:
            self.working += left
            for price, size in self.book.top(self._opposite(), len(self.book.sides[self._opposite()])):
                take = min(size, left)
                if take:
                    self._fill(self.p.end, price, take, "TAKER")
                    left -= take
            self.working -= left

    def finish(self) -> None:
        if not self.closed:
            self._close()


def per_key(frame: DataFrame, key: str, order: list[str], make, schema: str) -> DataFrame:
    """``make(key)`` gives (step, end): step(row) and end() return lists of output tuples. One
    machine per key, over partitions sorted by key and order."""
    fields = T.StructType.fromDDL(schema).fields
    names = frame.columns

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        now, machine, out = None, None, []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], names=[f.name for f in fields])

        at = names.index(key)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if machine is None or row[at] != now:
                    if machine is not None:
                        out += machine[1]()
                    now, machine = row[at], make(row[at])
                out += machine[0](dict(zip(names, row)))
            if len(out) >= 5000:
                yield batch_of(out)
                out = []
        if machine is not None:
            out += machine[1]()
        if out:
            yield batch_of(out)

    return frame.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
