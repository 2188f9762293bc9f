"""What a venue and a broker charge: rates by liquidity, and a commission with a minimum per order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Schedule:
    """Rates in hundredths of a bps of notional; commission in millionths of a tick a unit."""

    taker: int = 300
    maker: int = 100
    rebate: int = 150
    per_unit: int = 3_000_000
    minimum: int = 100_000_000

    def __post_init__(self) -> None:
        if min(self.taker, self.maker, self.rebate, self.per_unit, self.minimum) < 0:
            raise ValueError(f"rates can't be negative: {self}")

    def rate(self, liquidity: Column) -> Column:
        """Makers are paid the rebate; what is not known to be a maker or taker pays the greater rate."""
        return F.when(liquidity == "TAKER", self.taker).when(liquidity == "MAKER", self.maker - self.rebate).otherwise(max(self.taker, self.maker))

    def exchange(self, notional: Column, liquidity: Column) -> Column:
        """Of a notional in ticks, in millionths of a tick: exact."""
        return (notional * self.rate(liquidity)).cast("long")

    def commission(self, quantity: Column, before: Column) -> Column:
        """Of a fill after ``before`` units of its order: what the order owes now less what it has paid."""
        if not self.minimum:
            return quantity * self.per_unit
        owed = F.greatest((before + quantity) * self.per_unit, F.lit(self.minimum))
        paid = F.when(before > 0, F.greatest(before * self.per_unit, F.lit(self.minimum))).otherwise(0)
        return F.when(quantity > 0, owed - paid).otherwise(0)


def fee_bps(fee: Column, notional: Column) -> Column:
    """A fee in millionths of a tick in bps of the notional; 0 without one."""
    return F.when(notional != 0, fee / F.lit(1e6) / notional * 1e4).otherwise(F.lit(0.0))
