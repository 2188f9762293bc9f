"""Fees fill by fill, impact, latency, and the arithmetic of instruments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.functions import fees, tca
from tapeworks.functions.instrument import Instrument
from tapeworks.functions.tca import micro
from tapeworks.sources import market as M

SCHEDULE = fees.Schedule()


def fill_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchange fee, commission and both in bps of each fill; every eleventh's liquidity is unknown."""
    f = M.fills(spark, sf_dir).withColumn("liquidity", F.when((F.col("run_id") + F.col("fill")) % 11 == 0, "UNKNOWN").otherwise(F.col("liquidity")))
    w = Window.partitionBy("run_id").orderBy("t", "fill", "price", "qty", "l_partkey").rowsBetween(Window.unboundedPreceding, -1)  # one order's fills
    f = f.withColumns({"n": F.count("*").over(w) + 1, "before": F.coalesce(F.sum("qty").over(w), F.lit(0)), "notional": F.col("price") * F.col("qty")})
    f = f.withColumns({"exchange": SCHEDULE.exchange(F.col("notional"), F.col("liquidity")), "commission": SCHEDULE.commission(F.col("qty"), F.col("before"))})
    return f.select("run_id", "n", "liquidity", "exchange", "commission", micro(fees.fee_bps(F.col("exchange") + F.col("commission"), F.col("notional"))).alias("bps"))


FILL_FEES = f"""WITH {M.FILLS}, lq AS (SELECT * REPLACE (CASE WHEN (run_id + fill) % 11 = 0 THEN 'UNKNOWN' ELSE liquidity END AS liquidity), price * qty AS notional FROM fl),
bf AS (SELECT *, row_number() OVER w AS n, coalesce(sum(qty) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lq WINDOW w AS (PARTITION BY run_id ORDER BY t, fill, price, qty, l_partkey)),
fe AS (SELECT *, notional * CASE liquidity WHEN 'TAKER' THEN {SCHEDULE.taker} WHEN 'MAKER' THEN {SCHEDULE.maker - SCHEDULE.rebate} ELSE {max(SCHEDULE.taker, SCHEDULE.maker)} END AS exchange,
  CAST(greatest((before + qty) * {SCHEDULE.per_unit}, {SCHEDULE.minimum}) - CASE WHEN before > 0 THEN greatest(before * {SCHEDULE.per_unit}, {SCHEDULE.minimum}) ELSE 0 END AS BIGINT) AS commission FROM bf)
SELECT run_id, n, liquidity, CAST(exchange AS BIGINT) AS exchange, commission, CASE WHEN notional <> 0 THEN CAST(floor((exchange + commission)::DOUBLE / 1e6 / notional * 1e4 * 1e6 + 0.5) AS BIGINT) ELSE 0 END AS bps FROM fe"""


def impact(sigma: Column, rate: Column, model: str, factor: float = 0.7, least: float = 0.5, most: float = 20.0) -> Column:
    """Expected impact in bps: square_root or linear in the participation rate, within bounds; or none."""
    if model == "square_root":
        return tca.square_root_impact(sigma, rate, factor, least, most)
    if model == "linear":
        return F.least(F.greatest(F.lit(factor) * sigma * rate, F.lit(least)), F.lit(most))
    if model == "none":
        return F.lit(0.0)
    raise ValueError(f"model must be square_root, linear or none, not {model!r}")


#: Share of impact that stays.
PERMANENT = 0.4


def impact_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model's impact of a run, and the square root's split in what stays and what passes."""
    x = M.executions(spark, sf_dir)
    rate = F.col("filled") / (F.col("requested") + 100)
    sigma = (F.col("run_id") % 50).cast("double")
    root = impact(sigma, rate, "square_root")
    return x.select(
        "run_id", micro(root).alias("square_root"), micro(impact(sigma, rate, "linear")).alias("linear"), micro(impact(sigma, rate, "none")).alias("none"), micro(root * PERMANENT).alias("permanent"), micro(root * (1 - PERMANENT)).alias("temporary")
    )


_ROOT = "least(greatest(0.7::DOUBLE * (run_id % 50) * sqrt(filled::DOUBLE / (requested + 100)), 0.5), 20.0)::DOUBLE"
_LINE = "least(greatest(0.7::DOUBLE * (run_id % 50) * (filled::DOUBLE / (requested + 100)), 0.5), 20.0)::DOUBLE"
IMPACTS = f"""WITH {M.EXECUTIONS} SELECT run_id, CAST(floor({_ROOT} * 1e6 + 0.5) AS BIGINT) AS square_root, CAST(floor({_LINE} * 1e6 + 0.5) AS BIGINT) AS linear, 0::BIGINT AS "none",
  CAST(floor({_ROOT} * {PERMANENT}::DOUBLE * 1e6 + 0.5) AS BIGINT) AS permanent, CAST(floor({_ROOT} * {1 - PERMANENT!r}::DOUBLE * 1e6 + 0.5) AS BIGINT) AS temporary FROM ex"""


def upper_median(frame: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value in the middle of each group, of two the greater: from counts of distinct values."""
    counts = frame.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = counts.groupBy(*by).agg(F.sum("__n").alias("__all"))
    reached = counts.withColumn("__upto", F.sum("__n").over(w)).join(total, by).where(F.col("__upto") > F.floor(F.col("__all") / 2))
    return reached.groupBy(*by).agg(F.min(value).alias(value), F.first("__all").alias("n"))


def latency(kind: str, constant: int = 500_000, seed: int = 11, mean: float = 13.0, deviation: float = 0.5) -> Column:
    """Nanoseconds from decision to arrival: constant, or seeded log-normal draws."""
    if kind == "constant":
        return F.lit(constant).cast("long")
    if kind == "lognormal":
        return F.floor(F.exp(F.randn(seed) * deviation + mean)).cast("long")
    raise ValueError(f"latency must be constant or lognormal, not {kind!r}")


def observed_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observed time from order to fill by policy: the upper median of whole days."""
    f = M.fills(spark, sf_dir).select("policy", ((F.col("t") - F.col("start")) / F.lit(M.DAY)).cast("long").alias("days"))
    return upper_median(f, ["policy"], "days")


LATENCY = f"""WITH {M.FILLS}, d AS (SELECT policy, list_sort(list((t - start) // {M.DAY})) AS v FROM fl GROUP BY policy) SELECT policy, v[len(v) // 2 + 1] AS days, len(v) AS n FROM d"""

INSTRUMENT = Instrument()


def instrument_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part prices in ticks of 0.05 and back, within the band, sizes in whole lots, exact notionals."""
    p = M.read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(18,2)").alias("price"), F.col("p_size").cast("long").alias("size"))
    p = p.withColumns({"ticks": INSTRUMENT.to_ticks(F.col("price")), "lots": INSTRUMENT.whole_lots(F.col("size"))})
    notional = INSTRUMENT.notional(F.col("ticks"), F.col("lots"))
    return p.select("p_partkey", "ticks", INSTRUMENT.in_band(F.col("ticks") - 25000).alias("in_band"), "lots", (INSTRUMENT.to_price(F.col("ticks")) * 100).cast("long").alias("cents"), (notional * 100).cast("long").alias("notional_cents"))


ROUNDING = f"""WITH c AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS cents, p_size::BIGINT AS size FROM part), t AS (SELECT *, (cents * 2 + 5) // 10 AS ticks, size // {INSTRUMENT.lot} * {INSTRUMENT.lot} AS lots FROM c)
SELECT p_partkey, ticks, ticks - 25000 BETWEEN {INSTRUMENT.least_price} AND {INSTRUMENT.most_price} AS in_band, lots, ticks * 5 AS cents, ticks * 5 * lots AS notional_cents FROM t"""

QUERIES = {
    "fill_fees": (fill_fees, FILL_FEES),
    "impact_models": (impact_models, IMPACTS),
    "observed_latency": (observed_latency, LATENCY),
    "instrument_rounding": (instrument_rounding, ROUNDING),
}
