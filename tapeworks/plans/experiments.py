"""Experiments: grids of cells, cell aggregates, paired comparisons against a baseline."""

from __future__ import annotations

import math
import random

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.functions.tca import micro
from tapeworks.plans import research
from tapeworks.sources import market as M

BASELINE, RESAMPLES, CONFIDENCE = "1-URGENT", 500, 0.95
#: (experiment, baseline, cells as label, policy, style, tags)
GRIDS = (
    ("A_algorithm_comparison", "twap", tuple((p, p, "passive", f'{{"algorithm": "{p}"}}') for p in ("twap", "vwap", "pov", "is_baseline"))),
    ("B_passive_vs_aggressive", "twap_aggressive", tuple((f"twap_{s}", "twap", s, f'{{"style": "{s}"}}') for s in ("passive", "aggressive"))),
    ("C_latency_sensitivity", "latency_0ns", tuple((f"latency_{n}ns", "twap", "aggressive", f'{{"latency_ns": "{n}"}}') for n in (0, 1_000_000, 50_000_000))),
    ("D_participation_sensitivity", "participation_0.001", tuple((f"participation_{r}", "pov", "passive", f'{{"target_participation_rate": "{r}"}}') for r in (0.001, 0.01, 0.1))),
    ("E_queue_sensitivity", "queue_neutral", tuple((f"queue_{q}", "twap", "passive", f'{{"cancel_ahead_policy": "{q}"}}') for q in ("optimistic", "neutral", "conservative"))),
)


def grid(spark: SparkSession, seeds: list[int]) -> DataFrame:
    """A row per cell and seed of all experiments, with the fingerprint of the cell's configuration."""
    cells = [(e, label, label == base, policy, style, tags) for e, base, listed in GRIDS for label, policy, style, tags in listed]
    frame = spark.createDataFrame(cells, "experiment string, cell string, is_baseline boolean, policy string, style string, tags_json string")
    config = F.concat(F.lit('{"cell": "'), "cell", F.lit('", "policy": "'), "policy", F.lit('", "style": "'), "style", F.lit('"}'))
    return frame.select("*", M.fingerprint(config).alias("config_fingerprint"), F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))


def experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, [0, 1, 2])


_CELLS = ", ".join(f"('{e}', '{c}', {str(c == b).lower()}, '{p}', '{s}', '{t}')" for e, b, listed in GRIDS for c, p, s, t in listed)
GRID = f"""SELECT *, substr(sha256('{{"cell": "' || cell || '", "policy": "' || policy || '", "style": "' || style || '"}}'), 1, 16) AS config_fingerprint, seed::INTEGER AS seed
FROM (VALUES {_CELLS}) AS c(experiment, cell, is_baseline, policy, style, tags_json), (SELECT unnest([0, 1, 2])) AS s(seed)"""
GRID = GRID.replace("SELECT *, substr", "SELECT c.*, substr")


def cell_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per policy and queue mode: runs, runs whose cost can be told, and means over all runs."""
    from tapeworks.plans.analytics import mean

    x = M.costs(spark, sf_dir)
    return x.groupBy("policy", "queue_mode").agg(
        F.count("*").alias("n_runs"), F.count("shortfall").alias("n_usable"), mean("shortfall", "mean_is"), mean("completion", "mean_fill_ratio"), mean("participation", "mean_participation"), mean("fees_requested", "mean_fees"), mean("maker_ratio", "mean_maker_ratio")
    )


def _cells_sql() -> str:
    from tapeworks.plans.analytics import _means_sql

    means = {"shortfall": "mean_is", "completion": "mean_fill_ratio", "participation": "mean_participation", "fees_requested": "mean_fees", "maker_ratio": "mean_maker_ratio"}
    return f"WITH {M.COSTS} SELECT policy, queue_mode, count(*) AS n_runs, count(shortfall) AS n_usable, {_means_sql(means)} FROM co GROUP BY policy, queue_mode"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = M.costs(spark, sf_dir).groupBy("policy", "symbol", "seed").agg(F.floor(F.sum("shortfall") / F.count("shortfall") + 0.5).cast("long").alias("cost"))
    base = c.where(F.col("policy") == BASELINE).select("symbol", "seed", F.col("cost").alias("base"))
    return c.where(F.col("policy") != BASELINE).join(base, ["symbol", "seed"]).withColumn("d", F.col("cost") - F.col("base")).where("d IS NOT NULL")


PAIRS = f"""{M.COSTS}, cc AS (SELECT policy, symbol, seed, CAST(floor(sum(shortfall)::DOUBLE / count(shortfall) + 0.5) AS BIGINT) AS cost FROM co GROUP BY policy, symbol, seed),
dd AS (SELECT a.policy, a.symbol, a.seed, a.cost, b.cost AS base, a.cost - b.cost AS d FROM cc a JOIN cc b USING (symbol, seed) WHERE b.policy = '{BASELINE}' AND a.policy <> '{BASELINE}' AND a.cost - b.cost IS NOT NULL)"""


def paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies against the baseline over pairs of symbol and seed: means, wins by sign, ties, the
    sign test, and Cohen's d in millionths (null under two pairs or without spread)."""
    of = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    g = _pairs(spark, sf_dir).groupBy("policy").agg(
        F.count("*").alias("n_pairs"), F.sum("cost").alias("sum_a"), F.sum("base").alias("sum_b"), F.sum("d").alias("sum_d"), F.sum(F.floor(F.col("d") / 1000).cast("double") * F.floor(F.col("d") / 1000)).alias("sq"), F.sum(F.floor(F.col("d") / 1000)).alias("sd"), of(F.col("d") < 0).alias("wins"), of(F.col("d") > 0).alias("losses"), of(F.col("d") == 0).alias("ties")
    )
    n = F.col("n_pairs")
    variance = (F.col("sq") - F.col("sd") * F.col("sd") / n) / (n - 1)
    effect = F.when((n > 1), F.when(variance > 0, F.round(F.col("sd") / n / F.sqrt(variance) * 1e4).cast("long")))
    mean = lambda c: F.floor(F.col(c) / n + 0.5).cast("long")
    return g.select("policy", "n_pairs", mean("sum_a").alias("mean_a"), mean("sum_b").alias("mean_b"), mean("sum_d").alias("mean_difference"), "wins", "losses", "ties", micro(research.sign_test(F.col("wins"), F.col("losses"))).alias("sign_p"), effect.alias("effect"))


PAIRED = f"""WITH {PAIRS}, g AS (SELECT policy, count(*) AS n, sum(cost) AS a, sum(base) AS b, sum(d) AS d, sum(floor(d / 1000)::DOUBLE * floor(d / 1000)::DOUBLE) AS sq, sum(floor(d / 1000)::DOUBLE) AS sd,
  CAST(sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS losses, CAST(sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ties FROM dd GROUP BY policy),
v AS (SELECT *, CASE WHEN n > 1 THEN (sq - sd * sd / n) / (n - 1) END AS variance, least(wins, losses) AS k, wins + losses AS m FROM g)
SELECT policy, n AS n_pairs, CAST(floor(a::DOUBLE / n + 0.5) AS BIGINT) AS mean_a, CAST(floor(b::DOUBLE / n + 0.5) AS BIGINT) AS mean_b, CAST(floor(d::DOUBLE / n + 0.5) AS BIGINT) AS mean_difference, wins, losses, ties,
  CASE WHEN m > 0 THEN CAST(floor(least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + m * ln(0.5::DOUBLE))) FROM range(k + 1) AS t(i))) * 1e6 + 0.5) AS BIGINT) ELSE 1000000 END AS sign_p,
  CASE WHEN n > 1 AND variance > 0 THEN CAST(round(sd / n / sqrt(variance) * 1e4) AS BIGINT) END AS effect FROM v"""


def bootstrap(values: list[float], block: int, resamples: int, confidence: float, seed: str) -> tuple[float, float, float]:
    """Mean with the percentile interval of moving-block draws, widened to hold the mean; one value: itself."""
    n = len(values)
    centre = sum(values) / n
    if n == 1:
        return centre, centre, centre
    draw, size = random.Random(seed), min(block, n)
    means = []
    for _ in range(resamples):
        picked: list[float] = []
        for _ in range(math.ceil(n / size)):
            a = draw.randrange(n - size + 1)
            picked += values[a : a + size]
        means.append(sum(picked[:n]) / n)
    means.sort()
    tail = (1 - confidence) / 2
    low, high = means[int(tail * (resamples - 1))], means[math.ceil((1 - tail) * (resamples - 1))]
    return centre, min(low, centre), max(high, centre)


def _intervals(spark: SparkSession, sf_dir: str, block: int) -> DataFrame:
    """Per policy the mean paired difference with its interval, and whether that leaves out 0. A
    policy has as many differences as there are symbols and seeds, not runs."""
    per = _pairs(spark, sf_dir).groupBy("policy").agg(F.transform(F.array_sort(F.collect_list(F.struct("symbol", "seed", "d"))), lambda s: s["d"].cast("double")).alias("values"))

    def run(batches):
        for batch in batches:
            rows = [(p, len(v), *bootstrap(v, block, RESAMPLES, CONFIDENCE, f"11:{p}")) for p, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], names=["policy", "n", "mean", "low", "high"])

    found = per.mapInArrow(run, "policy string, n long, mean double, low double, high double")
    return found.withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def paired_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intervals(spark, sf_dir, 5)


def iid_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intervals(spark, sf_dir, 1)


QUERIES = {
    "experiment_grid": (experiment_grid, GRID),
    "cell_aggregate": (cell_aggregate, _cells_sql()),
    "paired_comparison": (paired_comparison, PAIRED),
    "paired_interval": (paired_interval, None),
    "iid_bootstrap": (iid_bootstrap, None),
}
