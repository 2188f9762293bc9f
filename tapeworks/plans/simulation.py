"""Queries that need a state machine per session; sessions run in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.operators import kernels
from tapeworks.sources import market as M

TICK = 5000


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on a valid ladder: bids below 10000, asks above, trades at the far touch's levels."""
    e = M.events(spark, sf_dir)
    step = F.col("price") % 5
    side = F.when(F.col("kind") == "BID", "BUY").when(F.col("kind") == "ASK", "SELL").otherwise(F.col("side"))
    kind = F.when(F.col("kind").isin("BID", "ASK"), "ADD").otherwise(F.col("kind"))
    own = F.when(side == "BUY", 9999 - step).otherwise(10001 + step)
    resting = F.when(side == "BUY", 10001 + step).otherwise(9999 - step)
    return e.select("symbol", "t", "seq", kind.alias("kind"), side.alias("side"), F.when(kind == "TRADE", resting).otherwise(own).cast("long").alias("price"), "qty")


def book_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best levels after each session and how often an event asked for more than was there."""

    def make(symbol):
        book = kernels.PriceBook(strict=False)

        def step(r):
            book.apply(r["kind"], r["side"], r["price"], r["qty"])
            return []

        def end():
            return [(symbol, side, k + 1, p, q, book.violations) for side in ("BUY", "SELL") for k, (p, q) in enumerate(book.top(side, 5))]

        return step, end

    return kernels.per_key(_stream(spark, sf_dir), "symbol", ["t", "seq"], make, "symbol long, side string, rank int, price long, size long, violations long")


def queue_neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order of 500 joins the first bid of each session; cancels ahead count by their share."""

    def make(symbol):
        book = kernels.PriceBook(strict=False)
        held: list[kernels.QueuePlace] = []
        filled = [0]

        def step(r):
            for place in held:
                if r["kind"] == "TRADE" and r["side"] == "SELL" and r["price"] == place.price:
                    filled[0] += place.trade(r["qty"])
                elif r["kind"] == "CANCEL" and r["side"] == "BUY" and r["price"] == place.price:
                    place.cancelled(r["qty"], book.sides["BUY"].get(place.price, 0), "neutral")
            book.apply(r["kind"], r["side"], r["price"], r["qty"])
            best = book.best("BUY")
            if not held and best is not None:
                held.append(kernels.QueuePlace("BUY", best, 500, book.sides["BUY"][best]))
            return []

        return step, lambda: [(symbol, p.price, p.ahead, filled[0]) for p in held]

    return kernels.per_key(_stream(spark, sf_dir), "symbol", ["t", "seq"], make, "symbol long, price long, ahead long, filled long")


def simulate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four policies in two styles over every session: a grid of runs, one state machine each."""
    e = _stream(spark, sf_dir)
    bounds = e.groupBy("symbol").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    runs = e.join(F.broadcast(bounds), "symbol")  # a row per session
    cells = [(p, s) for p in ("twap", "vwap", "pov", "is") for s in ("passive", "aggressive")]

    def make(symbol):
        state: list[kernels.Execution] = []

        def step(r):
            if not state:
                width = r["last"] - r["first"]
                for policy, style in cells:
                    parent = kernels.Parent("BUY", 300, r["first"] + width // 4, r["first"] + 3 * width // 4, policy, style, 10, 500_000, 0.1, width // 40, width // 20, profile=[1.0, 2.0, 3.0, 2.0])
                    state.append(kernels.Execution(parent))
            for x in state:
                x.event(r["t"], r["kind"], r["side"], r["price"], r["qty"])
            return []

        def end():
            out = []
            for (policy, style), x in zip(cells, state):
                x.finish()
                notional = sum(p * q for _, p, q, _ in x.fills)
                maker = sum(q for *_, q, kind in x.fills if kind == "MAKER")
                average = notional / x.filled if x.filled else None
                bps = (average - x.arrival2 / 2) / (x.arrival2 / 2) * 1e4 if average is not None and x.arrival2 else None
                out.append((symbol, policy, style, x.p.quantity, x.filled, maker, len(x.fills), average, bps))
            return out

        return step, end

    return kernels.per_key(runs, "symbol", ["t", "seq"], make, "symbol long, policy string, style string, requested long, filled long, maker long, n_fills long, average double, cost_bps double")


def queue_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order by order: an order of 500 joins the bid level of each session's thirtieth buy ADD, behind
    the orders that rest there. A cancel names a resting order of its level by the event's number."""

    def make(symbol):
        book, held, seen, filled = kernels.OrderBook(), [], [0], [0]

        def step(r):
            side, price, key = r["side"], r["price"], (r["side"], r["price"])
            mine = held[0] if held else None
            here = mine is not None and (mine.side, mine.price) == key
            if r["kind"] == "ADD":
                book.add(r["seq"], side, price, r["qty"])
                if side == "BUY":
                    seen[0] += 1
                    if seen[0] == 30:
                        held.append(kernels.queue_place("EXACT", side, price, 500, ahead=list(book.queues[key].items())))
            elif r["kind"] == "CANCEL" and book.queues.get(key):
                resting = list(book.queues[key])
                order = resting[r["seq"] % len(resting)]
                gone = book.cancel(order, min(r["qty"], book.queues[key][order]))
                if here:
                    mine.cancelled(gone, order)
            elif r["kind"] == "TRADE":
                resting = ("SELL" if side == "BUY" else "BUY", price)
                there = sum(book.queues.get(resting, {}).values())
                if mine is not None and (mine.side, mine.price) == resting:
                    filled[0] += mine.trade(r["qty"])
                if there:
                    book.trade(*resting, min(r["qty"], there))
            return []

        return step, lambda: [(symbol, q.price, q.ahead, filled[0], q.remaining, len(book.orders)) for q in held]

    return kernels.per_key(_stream(spark, sf_dir), "symbol", ["t", "seq"], make, "symbol long, price long, ahead long, filled long, remaining long, resting long")


QUERIES = {"book_replay": (book_replay, None), "queue_neutral": (queue_neutral, None), "queue_exact": (queue_exact, None), "simulate_runs": (simulate_runs, None)}
