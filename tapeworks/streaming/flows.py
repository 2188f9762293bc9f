"""The event stream as a stream: the same operators as in batch, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(events: DataFrame, key: list[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each key once while its time is above the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def bucket_volumes(trades: DataFrame, width: str, time: str = "ts", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Traded quantity and volume-weighted price by symbol in tumbling (or sliding) windows."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = trades.withWatermark(time, late).groupBy(window.alias("w"), "symbol")
    out = grouped.agg(F.sum("qty").alias("volume"), F.sum(F.col("price") * F.col("qty")).alias("notional"), F.count("*").alias("prints"))
    return out.select("symbol", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "volume", "prints", (F.col("notional") / F.col("volume")).alias("vwap"))


def sessions(events: DataFrame, gap: str, key: str, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Runs of events of a key with no gap as long as ``gap``."""
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key)
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")
