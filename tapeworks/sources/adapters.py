"""Adapters: what reads a kind of market data as canonical events, by name, and what it can offer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.sources import readers


@dataclass(frozen=True)
class Adapter:
    """read(spark, path, **options) -> canonical events; tier: L1, L2_MBP or L3_MBO."""

    name: str
    tier: str
    read: Callable[..., DataFrame]
    suffixes: tuple[str, ...] = ()
    help: str = ""


_known: dict[str, Adapter] = {}


def register(adapter: Adapter) -> Adapter:
    if adapter.tier not in readers.TIERS:
        raise ValueError(f"tier must be one of {sorted(readers.TIERS)}, not {adapter.tier!r}")
    if adapter.name in _known:
        raise ValueError(f"adapter {adapter.name!r} is there already")
    _known[adapter.name] = adapter
    return adapter


def names() -> list[str]:
    return sorted(_known)


def get(name: str) -> Adapter:
    if name not in _known:
        raise KeyError(f"no adapter {name!r}; there are {', '.join(names())}")
    return _known[name]


def for_path(path: str) -> Adapter:
    """The adapter whose suffix fits a path best."""
    fits = [(len(s), a.name) for a in _known.values() for s in a.suffixes if path.lower().endswith(s)]
    if not fits:
        raise KeyError(f"no adapter reads {path!r}")
    return get(max(fits)[1])


def probe(spark: SparkSession, name: str, path: str, **options) -> dict:
    """What a source holds, from one pass: rows, symbols, time range, kinds, and what is missing."""
    adapter = get(name)
    e = adapter.read(spark, path, **options)
    r = e.agg(
        F.count("*").alias("rows"),
        F.countDistinct("symbol").alias("symbols"),
        F.min("exchange_timestamp_ns").alias("first_ns"),
        F.max("exchange_timestamp_ns").alias("last_ns"),
        F.sort_array(F.collect_set("event_type")).alias("kinds"),  # as many as there are kinds of event
        F.sum(F.when(F.col("order_id").isNotNull(), 1).otherwise(0)).alias("with_order_id"),
        F.sum(F.when(F.col("side").isNull(), 1).otherwise(0)).alias("without_side"),
    ).first()
    return {"adapter": name, "tier": adapter.tier, **r.asDict()}


register(Adapter("normalized_parquet", "L2_MBP", readers.normalized_parquet, (".parquet",), "canonical columns in Parquet"))
register(Adapter("normalized_csv", "L2_MBP", readers.normalized_csv, (".csv",), "canonical columns in CSV with a header"))
register(Adapter("messages", "L3_MBO", readers.messages_csv, ("_message.csv", "_messages.csv"), "headerless order messages"))
