"""Order matching and books as window sums over levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sweep(levels: DataFrame, order: list[str], rank: list, size: str, quantity: str) -> DataFrame:
    """What an order takes from each level, best first: the least of the level and what is left."""
    w = Window.partitionBy(*order).orderBy(*rank).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(w), F.lit(0))
    return levels.withColumn("take", F.greatest(F.lit(0), F.least(F.col(size), F.col(quantity) - before)))


def fold_sweep(levels: Column, quantity: Column) -> Column:
    """The same over an array of (price, size) structs, best first: (filled, notional, levels, worst)."""
    zero = F.struct(F.lit(0).cast("long").alias("filled"), F.lit(0).cast("long").alias("notional"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("worst"))

    def step(s: Column, level: Column) -> Column:
        take = F.least(level["size"], quantity - s["filled"])
        return F.when(take > 0, F.struct((s["filled"] + take).alias("filled"), (s["notional"] + take * level["price"]).alias("notional"), (s["n"] + 1).alias("n"), level["price"].alias("worst"))).otherwise(s)

    return F.aggregate(levels, zero, step)


def is_marketable(buys: Column, limit: Column, touch: Column) -> Column:
    """Whether an order could trade now: no limit, or one at or through the opposite touch."""
    return limit.isNull() | F.coalesce(F.when(buys, limit >= touch).otherwise(limit <= touch), F.lit(False))


def match(levels: DataFrame, order: list[str], buys: Column, price: str, size: str, quantity: str, limit: str, tif: str, cap: str) -> DataFrame:
    """One row an order of what it takes from its levels, best first: up to its limit and level cap.

    Fill-or-kill takes all or nothing; immediate-or-cancel leaves nothing; books are not changed.
    Columns: filled, remaining, levels, notional, worst (null if nothing is filled). An order's
    window holds the levels of one side of one book.
    """
    best_first = F.when(buys, F.col(price)).otherwise(-F.col(price))
    w = Window.partitionBy(*order).orderBy(best_first)
    inside = F.col(limit).isNull() | F.when(buys, F.col(price) <= F.col(limit)).otherwise(F.col(price) >= F.col(limit))
    taken = sweep(levels.withColumn("__rank", F.row_number().over(w)), order, [best_first], size, quantity)
    take = F.when(inside & (F.col(cap).isNull() | (F.col("__rank") <= F.col(cap))), F.col("take")).otherwise(0)
    some = F.col("take") > 0
    per = taken.withColumn("take", take).groupBy(*order).agg(
        F.first(quantity).alias("__quantity"),
        F.first(tif).alias("__tif"),
        F.sum("take").alias("__filled"),
        F.count(F.when(some, 1)).alias("__levels"),
        F.sum(F.col("take") * F.col(price)).alias("__notional"),
        F.max_by(price, F.when(some, best_first)).alias("__worst"),
    )
    none = (F.col("__tif") == "FOK") & (F.col("__filled") < F.col("__quantity"))
    zero = F.lit(0).cast("long")
    return per.select(
        *order,
        F.when(none, zero).otherwise(F.col("__filled")).alias("filled"),
        F.when(none, F.col("__quantity")).when(F.col("__tif") == "IOC", zero).otherwise(F.col("__quantity") - F.col("__filled")).alias("remaining"),
        F.when(none, zero).otherwise(F.col("__levels")).alias("levels"),
        F.when(none, zero).otherwise(F.col("__notional")).alias("notional"),
        F.when(~none, F.col("__worst")).alias("worst"),
    )
