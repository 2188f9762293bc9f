"""Prices, quantities and notionals of an instrument, in exact decimals and integers."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Instrument:
    tick: Decimal = Decimal("0.05")
    lot: int = 5
    least_price: int = 1
    most_price: int = 1_000_000

    def __post_init__(self) -> None:
        if self.tick <= 0 or self.lot <= 0 or not 0 < self.least_price <= self.most_price:
            raise ValueError(f"not an instrument: {self}")

    def to_ticks(self, price: Column) -> Column:
        """A decimal price in ticks, halves rounded away from zero."""
        return F.round(price.cast("decimal(18,6)") / F.lit(self.tick).cast("decimal(18,6)"), 0).cast("long")

    def to_price(self, ticks: Column) -> Column:
        return (ticks.cast("decimal(18,0)") * F.lit(self.tick).cast("decimal(18,6)")).cast("decimal(28,6)")

    def in_band(self, ticks: Column) -> Column:
        return ticks.between(self.least_price, self.most_price)

    def whole_lots(self, quantity: Column) -> Column:
        """The greatest multiple of the lot that is not above the quantity."""
        return (F.floor(quantity / F.lit(self.lot)) * self.lot).cast("long")

    def notional(self, ticks: Column, quantity: Column) -> Column:
        return (self.to_price(ticks).cast("decimal(20,6)") * quantity.cast("decimal(12,0)")).cast("decimal(32,6)")
