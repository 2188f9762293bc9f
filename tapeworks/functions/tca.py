"""Scalar expressions of execution costs. Bps above 0 are worse; what can't be measured is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micro(x: Column) -> Column:
    """x in millionths, rounded half up: the same long in every engine."""
    return F.floor(x * F.lit(1e6) + F.lit(0.5)).cast("long")


def sign(side: Column) -> Column:
    return F.when(side == "BUY", F.lit(1)).otherwise(F.lit(-1))


def signed_cost_bps(price: Column, benchmark: Column, side: Column) -> Column:
    """Positive when worse than the benchmark; null without a positive benchmark."""
    return F.when(benchmark > 0, (price - benchmark) / benchmark * F.lit(1e4) * sign(side))


def markout_bps(fill: Column, later: Column, side: Column) -> Column:
    """Positive when the market moved against the fill afterwards."""
    return F.when(fill > 0, (fill - later) / fill * F.lit(1e4) * sign(side))


def shortfall_bps(average: Column, arrival: Column, terminal: Column, fill_ratio: Column, side: Column) -> Column:
    """Filled part against arrival, the rest at the terminal price; a missing leg that counts: null."""
    filled = F.when(fill_ratio > 0, signed_cost_bps(average, arrival, side) * fill_ratio).otherwise(F.lit(0.0))
    rest = F.when(fill_ratio < 1, signed_cost_bps(terminal, arrival, side) * (F.lit(1.0) - fill_ratio)).otherwise(F.lit(0.0))
    return filled + rest


def fees_bps(fees: Column, arrival: Column, quantity: Column) -> Column:
    return F.when((arrival > 0) & (quantity > 0), fees * F.lit(1e4) / (arrival * quantity))


def square_root_impact(sigma_bps: Column, rate: Column, factor: float, least: float, most: float) -> Column:
    return F.least(F.greatest(F.lit(factor) * sigma_bps * F.sqrt(rate), F.lit(least)), F.lit(most))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; 0 where the denominator is not positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))
