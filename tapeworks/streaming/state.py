"""Per-key state in streams: trailing sums event by event, and timers that fire when time has passed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def trailing_sums(events: DataFrame, key: str, span_ns: int, late: str = "0 seconds", time: str = "ts") -> DataFrame:
    """Events (key, ts, t in ns, seq, qty) with the sum of qty over the last ``span_ns`` of their key, up
    to themselves. A micro-batch's events are taken in order; of the state only what a later event
    can still look back on is kept. Events older than the last one seen are dropped."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        new = pd.concat(list(batches)).sort_values(["t", "seq"])
        out = []
        for t, seq, qty in zip(new["t"].tolist(), new["seq"].tolist(), new["qty"].tolist()):
            if held and t < held[-1][0]:
                continue
            held = [(a, q) for a, q in held if a >= t - span_ns]
            held.append((t, qty))
            out.append((k[0], t, seq, sum(q for _, q in held)))
        if held:
            state.update(([t for t, _ in held], [q for _, q in held]))
        yield pd.DataFrame(out, columns=[key, "t", "seq", "trailing"])

    kind = dict(events.dtypes)[key]
    out = f"{key} {kind}, t long, seq long, trailing long"
    return events.withWatermark(time, late).groupBy(key).applyInPandasWithState(step, out, "t array<long>, qty array<long>", "append", GroupStateTimeout.NoTimeout)


def due_actions(orders: DataFrame, key: str, delay_ms: int, late: str = "0 seconds", time: str = "ts") -> DataFrame:
    """A row for each key once the watermark is ``delay_ms`` past its last event: its count and last
    time in ms. The timer moves on with every event and the state goes when it fires."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, last = state.get
            state.remove()
            yield pd.DataFrame([(k[0], n, last)], columns=[key, "n", "last_ms"])
            return
        n, last = state.get if state.exists else (0, 0)
        for b in batches:
            n += len(b)
            last = max(last, int(b[time].max().value // 1_000_000))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last + delay_ms, state.getCurrentWatermarkMs() + 1))

    kind = dict(orders.dtypes)[key]
    out = f"{key} {kind}, n long, last_ms long"
    return orders.withWatermark(time, late).groupBy(key).applyInPandasWithState(step, out, "n long, last_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def observed(frame: DataFrame, observe, name: str, checkpoint: str):
    """A query that hands every micro-batch to an observer beside the main sink; runs what is there and stops."""
    q = frame.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, k: observe(batch, k)).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
