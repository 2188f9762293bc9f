"""All registered queries of the engine's own operators, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeworks.plans import analytics, books, costmodel, experiments, labels, orders, research, series, simulation, validation

ALL = analytics.QUERIES | series.QUERIES | books.QUERIES | research.QUERIES | simulation.QUERIES | validation.QUERIES | orders.QUERIES | costmodel.QUERIES | labels.QUERIES | experiments.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql is not None}
