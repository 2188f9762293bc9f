"""The eight result tables: schemas, partition keys, and what fills them from the star-schema data."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.sources import market as M
from tapeworks.sources.readers import Store

_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _schema(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split(" ") for c in columns.split(", "))])


# Names and types of the columns of each table.
SCHEMAS = {
    name: _schema(ddl)
    for name, ddl in {
        "datasets": "dataset_name string, dataset_version string, data_type string, provenance string, redistributable boolean, license string, config_fingerprint string, ingested_at_utc string",
        "events": "dataset_name string, seed int, sequence_id long, exchange_timestamp_ns long, receive_timestamp_ns long, symbol string, event_type string, side string, price_ticks long, quantity_base long, order_id long, trade_id long, flags int, source string",
        "executions": "run_id string, parent_order_id string, symbol string, side string, policy string, requested_base long, filled_base long, unfilled_base long, completion_rate double, start_ns long, end_ns long, duration_ns long, arrival_mid_ticks double, terminal_mid_ticks double, avg_fill_price_ticks double, notional double, fees_total double, maker_filled_base long, taker_filled_base long, maker_fill_ratio double, market_volume_base long, participation_rate double, n_child_orders int, n_rejects int, n_cancels int, queue_mode string, latency_basis string, counterfactual_mode string, seed int, config_fingerprint string",
        "child_orders": "run_id string, seed int, client_order_id string, parent_order_id string, slice_index int, side string, quantity_base long, filled_base long, status string, style string, order_type string, time_in_force string, placed_price_ticks long, estimated_queue_ahead_base long, created_ns long, working_ns long, terminal_ns long",
        "fills": "run_id string, seed int, fill_id long, client_order_id string, parent_order_id string, symbol string, side string, price_ticks long, quantity_base long, timestamp_ns long, liquidity_flag string, fee double, queue_wait_ns long, sequence_id long",
        "tca_metrics": "run_id string, seed int, policy string, side string, fill_ratio double, arrival_mid_ticks double, interval_vwap_ticks double, interval_twap_ticks double, interval_mid_ticks double, terminal_mid_ticks double, cost_vs_arrival_bps double, cost_vs_vwap_bps double, cost_vs_twap_bps double, cost_vs_interval_mid_bps double, cost_vs_terminal_bps double, implementation_shortfall_bps double, spread_cost_bps double, fees_bps double, timing_bps double, residual_impact_bps double, opportunity_cost_bps double, n_mid_observations int, n_trade_prints int, window_volume_base long",
        "markouts": "run_id string, seed int, horizon_ns long, n_fills int, n_measurable int, volume_weighted_bps double, mean_bps double, median_bps double, p25_bps double, p75_bps double, worst_bps double, best_bps double",
        "experiment_runs": "experiment string, cell string, seed int, metric string, metric_value double, config_fingerprint string, git_commit string, git_dirty boolean, recorded_at_utc string, tags_json string",
    }.items()
}
KEYS = {"events": ["dataset_name", "seed"], "executions": ["seed"], "fills": ["seed"], "tca_metrics": ["seed"], "markouts": ["seed"], "child_orders": ["seed"]}


def store(spark: SparkSession, root: str) -> Store:
    return Store(spark, root, SCHEMAS, KEYS)


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = M.executions(spark, sf_dir)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    run = F.col("run_id").cast("string")
    return x.select(
        run.alias("run_id"),
        F.concat(F.lit("P-"), run).alias("parent_order_id"),
        F.col("symbol").cast("string").alias("symbol"),
        "side",
        "policy",
        F.col("requested").alias("requested_base"),
        F.col("filled").alias("filled_base"),
        (F.col("requested") - F.col("filled")).alias("unfilled_base"),
        share("filled", "requested").alias("completion_rate"),
        F.col("start").alias("start_ns"),
        (F.col("start") + F.col("duration")).alias("end_ns"),
        F.col("duration").alias("duration_ns"),
        (F.col("arrival2") / 2).alias("arrival_mid_ticks"),
        (F.col("terminal2") / 2).alias("terminal_mid_ticks"),
        F.col("average").alias("avg_fill_price_ticks"),
        F.col("notional").cast("double").alias("notional"),
        (F.col("fee_micro") / 1e6).alias("fees_total"),
        F.col("maker").alias("maker_filled_base"),
        (F.col("filled") - F.col("maker")).alias("taker_filled_base"),
        share("maker", "filled").alias("maker_fill_ratio"),
        F.col("market_volume").alias("market_volume_base"),
        share("filled", "market_volume").alias("participation_rate"),
        F.col("n_fills").cast("int").alias("n_child_orders"),
        F.lit(0).alias("n_rejects"),
        F.lit(0).alias("n_cancels"),
        "queue_mode",
        "latency_basis",
        "counterfactual_mode",
        F.col("seed").cast("int").alias("seed"),
        "config_fingerprint",
    )


def tca_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = M.attribution(spark, sf_dir)
    bps = {"vs_arrival": "cost_vs_arrival_bps", "vs_vwap": "cost_vs_vwap_bps", "vs_twap": "cost_vs_twap_bps", "vs_terminal": "cost_vs_terminal_bps", "shortfall": "implementation_shortfall_bps", "spread_cost": "spread_cost_bps", "fees": "fees_bps", "timing": "timing_bps", "residual": "residual_impact_bps", "opportunity": "opportunity_cost_bps"}
    return a.select(
        F.col("run_id").cast("string").alias("run_id"),
        F.col("seed").cast("int").alias("seed"),
        "policy",
        "side",
        (F.col("completion") / 1e6).alias("fill_ratio"),
        (F.col("arrival2") / 2).alias("arrival_mid_ticks"),
        F.col("vwap").alias("interval_vwap_ticks"),
        F.col("twap").alias("interval_twap_ticks"),
        (F.col("terminal2") / 2).alias("terminal_mid_ticks"),
        *[(F.col(c) / 1e6).alias(n) for c, n in bps.items()],
        F.col("n_mids").cast("int").alias("n_mid_observations"),
        F.col("n_prints").cast("int").alias("n_trade_prints"),
        F.col("market_volume").alias("window_volume_base"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = M.fills(spark, sf_dir)
    run = F.col("run_id").cast("string")
    wait = F.when(F.col("liquidity") == "MAKER", F.col("t") - F.col("start")).otherwise(0)
    return f.select(
        run.alias("run_id"), F.col("seed").cast("int").alias("seed"), F.col("fill").cast("long").alias("fill_id"), F.format_string("%s-%04d-%06d", run, F.lit(0), F.col("fill").cast("int")).alias("client_order_id"),
        F.concat(F.lit("P-"), run).alias("parent_order_id"), F.col("symbol").cast("string").alias("symbol"), "side", F.col("price").alias("price_ticks"), F.col("qty").alias("quantity_base"), F.col("t").alias("timestamp_ns"),
        F.col("liquidity").alias("liquidity_flag"), (F.col("fee_micro") / 1e6).alias("fee"), wait.alias("queue_wait_ns"), F.col("fill").cast("long").alias("sequence_id"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = M.events(spark, sf_dir)
    kind = F.when(F.col("kind").isin("BID", "ASK"), "SNAPSHOT").otherwise(F.col("kind"))
    side = F.when(F.col("kind") == "BID", "BUY").when(F.col("kind") == "ASK", "SELL").otherwise(F.col("side"))
    flags = F.when(F.col("kind") == "TRADE", F.when(F.col("side") == "BUY", 1).otherwise(2)).otherwise(0)
    return e.select(
        F.lit("star").alias("dataset_name"), (F.col("seq") % 5).cast("int").alias("seed"), F.col("seq").alias("sequence_id"), F.col("t").alias("exchange_timestamp_ns"), F.col("symbol").cast("string").alias("symbol"),
        kind.alias("event_type"), side.alias("side"), F.col("price").alias("price_ticks"), F.col("qty").alias("quantity_base"), flags.alias("flags"), F.lit("events").alias("source"),
    )


FILLED = {"executions": executions, "tca_metrics": tca_metrics, "fills": fills, "events": events}


def fill_store(spark: SparkSession, sf_dir: str, root: str) -> Store:
    """The store with the tables that the star-schema data can fill; the others stay empty."""
    out = store(spark, root)
    for name, build in FILLED.items():
        out.write(name, build(spark, sf_dir))
    return out


def dependencies(sql: str) -> set[str]:
    """Which of the eight tables a query names, as whole words outside comments and quotes."""
    text = re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", " ", sql, flags=re.S)
    return {name for name in SCHEMAS if re.search(rf"(?<![\w.]){name}(?!\w)", text, re.I)}


def missing(tables: Store, sql: str) -> list[str]:
    """Tables a query needs that were never written."""
    there = tables.status()
    return sorted(name for name in dependencies(sql) if not there[name])
