"""The seven analytical queries, each with all columns of its contract.

Averages are of exact long sums (bps in millionths), divided once; rows where a column is null
don't count in its own average, and a sum of two columns is null where either is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.functions import tca
from tapeworks.functions.tca import micro
from tapeworks.operators import asof
from tapeworks.sources import market as M

MEAN = "CAST(floor(sum({0})::DOUBLE / count({0}) + 0.5) AS BIGINT) AS {1}"
HOURS = 3_600_000_000_000


def mean(c, name: str):
    """The average of long millionths, as a long: one exact sum, one division."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(F.sum(c) / F.count(c) + 0.5).cast("long").alias(name)


def _means(columns: dict[str, str]) -> list:
    return [mean(c, n) for c, n in columns.items()]


def _means_sql(columns: dict[str, str]) -> str:
    return ", ".join(MEAN.format(c, n) for c, n in columns.items())


SUMMARY_MEANS = {
    "completion": "mean_fill_ratio",
    "participation": "mean_participation",
    "maker_ratio": "mean_maker_ratio",
    "vs_arrival": "mean_cost_vs_arrival",
    "vs_vwap": "mean_cost_vs_vwap",
    "vs_twap": "mean_cost_vs_twap",
    "shortfall": "mean_is",
    "fees": "mean_fees",
}


def execution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = [F.min(c).alias(c) for c in ("queue_mode", "latency_basis", "counterfactual_mode")]
    x = M.costs(spark, sf_dir).groupBy("policy", "side").agg(F.count("*").alias("n_runs"), *_means(SUMMARY_MEANS), *modes)
    return x.orderBy(F.col("mean_is").asc_nulls_last(), "policy", "side")


SUMMARY = f"""WITH {M.COSTS}
SELECT policy, side, count(*) AS n_runs, {_means_sql(SUMMARY_MEANS)}, min(queue_mode) AS queue_mode, min(latency_basis) AS latency_basis, min(counterfactual_mode) AS counterfactual_mode
FROM co GROUP BY policy, side"""


def benchmark_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = M.costs(spark, sf_dir).where("vs_arrival IS NOT NULL AND vs_vwap IS NOT NULL")
    gap = F.floor(F.sum("vs_arrival") / F.count("vs_arrival") - F.sum("vs_vwap") / F.count("vs_vwap") + 0.5).cast("long").alias("arrival_minus_vwap")
    drift = micro(F.sum(F.col("terminal2") - F.col("arrival2")) / F.count(F.col("terminal2") - F.col("arrival2")) / 2).alias("mean_mid_drift")
    x = x.groupBy("policy", "side").agg(
        F.count("*").alias("n_runs"), *_means({"vs_arrival": "mean_vs_arrival", "vs_vwap": "mean_vs_vwap", "vs_twap": "mean_vs_twap"}), gap, drift, F.min("n_mids").alias("min_mid_observations"), F.min("n_prints").alias("min_trade_prints")
    )
    return x.orderBy(F.abs("arrival_minus_vwap").desc(), "policy", "side")


DISAGREEMENT = f"""WITH {M.COSTS}
SELECT policy, side, count(*) AS n_runs, {_means_sql({'vs_arrival': 'mean_vs_arrival', 'vs_vwap': 'mean_vs_vwap', 'vs_twap': 'mean_vs_twap'})},
  CAST(floor(sum(vs_arrival)::DOUBLE / count(vs_arrival) - sum(vs_vwap)::DOUBLE / count(vs_vwap) + 0.5) AS BIGINT) AS arrival_minus_vwap,
  CAST(floor(sum(terminal2 - arrival2)::DOUBLE / count(terminal2 - arrival2) / 2 * 1e6 + 0.5) AS BIGINT) AS mean_mid_drift, min(n_mids) AS min_mid_observations, min(n_prints) AS min_trade_prints
FROM co WHERE vs_arrival IS NOT NULL AND vs_vwap IS NOT NULL GROUP BY policy, side"""

PARTS = {"shortfall": "mean_is", "total": "mean_is_filled", "spread_cost": "mean_spread_cost", "fees": "mean_fees", "timing": "mean_timing", "residual": "mean_residual", "opportunity": "mean_opportunity"}


def cost_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = M.attribution(spark, sf_dir).withColumn("total", F.col("vs_arrival") + F.col("fees"))
    average = lambda c: F.sum(c) / F.count(c)
    share = F.when(average("total") == 0, None).otherwise(micro(average("residual") / average("total"))).alias("residual_share")
    x = x.groupBy("policy", "side").agg(F.count("*").alias("n_runs"), *_means(PARTS), share)
    return x.orderBy(F.col("residual_share").desc_nulls_last(), "policy", "side")


ATTRIBUTION = f"""WITH {M.ATTRIBUTION}, r AS (SELECT *, vs_arrival + fees AS total FROM an)
SELECT policy, side, count(*) AS n_runs, {_means_sql(PARTS)},
  CASE WHEN sum(total) = 0 THEN NULL ELSE CAST(floor((sum(residual)::DOUBLE / count(residual)) / (sum(total)::DOUBLE / count(total)) * 1e6 + 0.5) AS BIGINT) END AS residual_share
FROM r GROUP BY policy, side"""


def run_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run's cost is made of, with the fills that had no mid before them."""
    return M.attribution(spark, sf_dir).select("run_id", "is_filled", "shortfall", "spread_cost", "fees", "timing", "residual", "opportunity", "explained", "n_without_mid", "n_fills")


def trade_markouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per trade and horizon (hours) the first mid at or after it, and the markout; null where there
    is no mid or the trade has no positive price."""
    q = M.quotes(spark, sf_dir)
    trades = q.where("kind = 'TRADE'").select("symbol", "seq", "t", "side", "price", "qty")
    hours = F.explode(F.array_sort(F.array_distinct(F.array(*[F.lit(h) for h in M.HORIZONS])))).alias("horizon")
    probes = trades.select("*", hours).withColumn("at", F.col("t") + F.col("horizon") * F.lit(HOURS))
    mids = q.where("mid2 IS NOT NULL").select("symbol", F.col("t").alias("mt"), F.col("seq").alias("ms"), "mid2")
    found = asof.asof_join(probes, mids, ["symbol"], "at", "mt", "ms", ["mid2"], "forward")
    return found.withColumn("markout", micro(tca.markout_bps(F.col("price"), F.col("mid2") / 2, F.col("side"))))


MARKOUTS = (
    M.QUOTES
    + f""",
hz AS (SELECT unnest([1, 10, 60]) AS horizon),
mk AS (
  SELECT tr.symbol, tr.seq, tr.t, tr.side, tr.price, tr.qty, horizon,
    (SELECT arg_min(m.mid2, (m.t, m.seq)) FROM qu m WHERE m.mid2 IS NOT NULL AND m.symbol = tr.symbol AND m.t >= tr.t + horizon * {HOURS}) AS mid2
  FROM qu tr, hz WHERE kind = 'TRADE'),
mo AS (SELECT *, CASE WHEN price > 0 THEN CAST(floor((price - mid2::DOUBLE / 2) / price * 1e4 * CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * 1e6 + 0.5) AS BIGINT) END AS markout FROM mk)"""
)


def markout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per symbol, side and horizon: counts, weighted mean, mean, quartiles, worst and best."""
    m = trade_markouts(spark, sf_dir)
    weighted = F.floor(F.sum(F.col("markout") * F.col("qty")) / F.sum(F.when(F.col("markout").isNotNull(), F.col("qty"))) + 0.5).cast("long")
    quartile = lambda p, n: F.floor(F.expr(f"percentile(markout, {p})")).cast("long").alias(n)
    return m.groupBy("symbol", "side", "horizon").agg(
        F.count("*").alias("n_fills"), F.count("markout").alias("n_measurable"), weighted.alias("weighted"), mean("markout", "mean"), F.max("markout").alias("worst"), F.min("markout").alias("best"), quartile(0.25, "p25"), quartile(0.5, "median"), quartile(0.75, "p75")
    )


MARKOUT_SUMMARY = f"""WITH {MARKOUTS}
SELECT symbol, side, horizon::INTEGER AS horizon, count(*) AS n_fills, count(markout) AS n_measurable,
  CAST(floor(sum(markout * qty)::DOUBLE / sum(CASE WHEN markout IS NOT NULL THEN qty END)::DOUBLE + 0.5) AS BIGINT) AS weighted, {MEAN.format('markout', 'mean')}, max(markout) AS worst, min(markout) AS best,
  CAST(floor(quantile_cont(markout, 0.25)) AS BIGINT) AS p25, CAST(floor(quantile_cont(markout, 0.5)) AS BIGINT) AS median, CAST(floor(quantile_cont(markout, 0.75)) AS BIGINT) AS p75
FROM mo GROUP BY symbol, side, horizon"""


def run_markouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run and horizon in days: fills, those with a quoted day at or after it, weighted and median."""
    f = M.fills(spark, sf_dir).select("run_id", "symbol", "side", "price", "qty", F.floor(F.col("t") / F.lit(M.DAY)).cast("long").alias("d"))
    f = f.select("*", F.explode(F.array(*[F.lit(h) for h in M.HORIZONS])).alias("horizon")).withColumn("day", F.col("d") + F.col("horizon"))
    days = M.market_days(spark, sf_dir).select("symbol", "day", F.col("next.mid2").alias("mid2"))
    m = f.join(days, ["symbol", "day"], "left").withColumn("markout", micro(tca.markout_bps(F.col("price"), F.col("mid2") / 2, F.col("side"))))
    weighted = F.floor(F.sum(F.col("markout") * F.col("qty")) / F.sum(F.when(F.col("markout").isNotNull(), F.col("qty"))) + 0.5).cast("long")
    return m.groupBy("run_id", "horizon").agg(F.count("*").alias("n_fills"), F.count("markout").alias("n_measurable"), weighted.alias("weighted"), F.floor(F.expr("percentile(markout, 0.5)")).cast("long").alias("median"))


RUN_MARKOUTS = (
    M.EXECUTIONS
    + f""",
hz AS (SELECT unnest([1, 10, 60]) AS horizon),
rm0 AS (SELECT run_id, side, price, qty, horizon, (SELECT arg_min(md.mid2, md.day) FROM md WHERE md.symbol = fl.symbol AND md.day >= fl.t // {M.DAY} + horizon) AS mid2 FROM fl, hz),
rm1 AS (SELECT *, CASE WHEN price > 0 THEN CAST(floor((price - mid2::DOUBLE / 2) / price * 1e4 * CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * 1e6 + 0.5) AS BIGINT) END AS markout FROM rm0),
rm AS (SELECT run_id, horizon, count(*) AS n_fills, count(markout) AS n_measurable, CAST(floor(sum(markout * qty)::DOUBLE / sum(CASE WHEN markout IS NOT NULL THEN qty END)::DOUBLE + 0.5) AS BIGINT) AS weighted,
  CAST(floor(quantile_cont(markout, 0.5)) AS BIGINT) AS median FROM rm1 GROUP BY run_id, horizon)"""
)


def markout_adverse_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = run_markouts(spark, sf_dir).join(M.runs(spark, sf_dir).select("run_id", "policy", "side"), "run_id")
    m = m.withColumns({"gap": F.col("weighted") - F.col("median"), "coverage": micro(F.col("n_measurable") / F.nullif(F.col("n_fills"), F.lit(0)))})
    m = m.groupBy("policy", "side", "horizon").agg(
        (F.first("horizon") * 86400).cast("long").alias("horizon_s"),
        F.count("*").alias("n_runs"),
        *_means({"weighted": "mean_weighted", "median": "mean_median", "gap": "mean_gap", "coverage": "mean_coverage"}),
        F.sum("n_fills").alias("total_fills"),
        F.sum("n_measurable").alias("total_measurable"),
    )
    return m.orderBy("policy", "side", "horizon")


MARKOUT_SQL = f"""WITH {RUN_MARKOUTS}, j AS (SELECT rm.*, policy, side, weighted - median AS gap, CAST(floor(n_measurable::DOUBLE / nullif(rm.n_fills, 0) * 1e6 + 0.5) AS BIGINT) AS coverage FROM rm JOIN ex USING (run_id))
SELECT policy, side, horizon::INTEGER AS horizon, horizon::BIGINT * 86400 AS horizon_s, count(*) AS n_runs, {_means_sql({'weighted': 'mean_weighted', 'median': 'mean_median', 'gap': 'mean_gap', 'coverage': 'mean_coverage'})},
  CAST(sum(n_fills) AS BIGINT) AS total_fills, CAST(sum(n_measurable) AS BIGINT) AS total_measurable
FROM j GROUP BY policy, side, horizon"""

CAVEAT = "queue position is an estimate from aggregated data"


def policy_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = M.costs(spark, sf_dir).where("queue_mode = 'APPROXIMATE'")
    inner = x.groupBy("policy", "seed", "config_fingerprint").agg(mean("shortfall", "c"))
    x = inner.groupBy("policy").agg(F.count("*").alias("n_observations"), F.min("c").alias("min_is"), F.max("c").alias("max_is"), (F.max("c") - F.min("c")).alias("policy_spread"), mean("c", "mean_is"), F.lit(CAVEAT).alias("caveat"))
    return x.orderBy(F.col("policy_spread").desc_nulls_last(), "policy")


SENSITIVITY = f"""WITH {M.COSTS}, i AS (SELECT policy, seed, config_fingerprint, {MEAN.format('shortfall', 'c')} FROM co WHERE queue_mode = 'APPROXIMATE' GROUP BY ALL)
SELECT policy, count(*) AS n_observations, min(c) AS min_is, max(c) AS max_is, max(c) - min(c) AS policy_spread, {MEAN.format('c', 'mean_is')}, '{CAVEAT}' AS caveat FROM i GROUP BY policy"""


def fill_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = M.fills(spark, sf_dir)
    wait = F.when(F.col("liquidity") == "MAKER", F.floor((F.col("t") - F.col("start")) / F.lit(1_000_000_000)).cast("long"))
    per = F.when(F.sum("qty") != 0, F.floor(F.sum("fee_micro") / F.sum("qty") + 0.5).cast("long"))
    x = f.groupBy("side", "liquidity").agg(
        F.count("*").alias("n_fills"), F.sum("qty").alias("filled"), mean("price", "mean_price"), per.alias("fee_per_unit"), mean("fee_micro", "mean_fee"), mean(wait, "mean_wait_s"), F.max(wait).alias("max_wait_s")
    )
    return x.orderBy("side", "liquidity")


QUALITY = f"""WITH {M.FILLS}, w AS (SELECT *, CASE WHEN liquidity = 'MAKER' THEN (t - start) // 1000000000 END AS wait FROM fl)
SELECT side, liquidity, count(*) AS n_fills, CAST(sum(qty) AS BIGINT) AS filled, {MEAN.format('price', 'mean_price')},
  CAST(floor(sum(fee_micro)::DOUBLE / nullif(sum(qty), 0)::DOUBLE + 0.5) AS BIGINT) AS fee_per_unit, {MEAN.format('fee_micro', 'mean_fee')}, {MEAN.format('wait', 'mean_wait_s')}, max(wait) AS max_wait_s
FROM w GROUP BY side, liquidity"""


def data_quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event counts per data set (the symbol's) beside one-row summaries of runs, sources and trials."""
    e, x = M.events(spark, sf_dir), M.executions(spark, sf_dir)
    count_if = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    by = e.groupBy("symbol").agg(
        F.count("*").alias("n_events"),
        F.countDistinct(F.col("seq") % 20).alias("n_seeds"),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
        count_if(F.col("kind") == "TRADE").alias("trades"),
        count_if(F.col("kind") == "ADD").alias("adds"),
        count_if(F.col("kind") == "CANCEL").alias("cancels"),
        count_if(F.col("seq") % 17 == 0).alias("without_receive_t"),
    )
    distinct = {"seed": "n_seed_values", "policy": "n_policies", "queue_mode": "n_queue_modes", "latency_basis": "n_latency_bases", "counterfactual_mode": "n_counterfactual_modes"}
    runs = x.agg(F.count("*").alias("n_runs"), *[F.countDistinct(c).alias(n) for c, n in distinct.items()], count_if((F.col("maker") > 0) & (F.col("maker") < F.col("filled"))).alias("n_mixed_liquidity_runs"))
    sources = M.read(spark, sf_dir, "supplier").agg(
        F.min(F.when(F.col("s_suppkey") % 2 == 0, "SYNTHETIC").otherwise("CAPTURED")).alias("data_type"), F.min("s_name").alias("provenance"), F.min(F.lit("CC0-1.0")).alias("license"), F.countDistinct("s_nationkey").alias("n_config_fingerprints")
    )
    trials = M.read(spark, sf_dir, "customer").agg(F.count("*").alias("n_experiment_rows"), count_if(F.col("c_acctbal") < 0).alias("n_dirty_runs"), F.countDistinct("c_mktsegment").alias("n_git_commits"))
    one = F.broadcast(runs.crossJoin(F.broadcast(sources)).crossJoin(F.broadcast(trials)))  # one row each
    return by.crossJoin(one)


DATA_QUALITY = f"""WITH {M.EVENTS}, {M.EXECUTIONS},
b AS (SELECT symbol, count(*) AS n_events, count(DISTINCT seq % 20) AS n_seeds, min(t) AS first_t, max(t) AS last_t, CAST(sum(CASE WHEN kind = 'TRADE' THEN 1 ELSE 0 END) AS BIGINT) AS trades,
  CAST(sum(CASE WHEN kind = 'ADD' THEN 1 ELSE 0 END) AS BIGINT) AS adds, CAST(sum(CASE WHEN kind = 'CANCEL' THEN 1 ELSE 0 END) AS BIGINT) AS cancels, CAST(sum(CASE WHEN seq % 17 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS without_receive_t FROM ev GROUP BY symbol),
r AS (SELECT count(*) AS n_runs, count(DISTINCT seed) AS n_seed_values, count(DISTINCT policy) AS n_policies, count(DISTINCT queue_mode) AS n_queue_modes, count(DISTINCT latency_basis) AS n_latency_bases,
  count(DISTINCT counterfactual_mode) AS n_counterfactual_modes, CAST(sum(CASE WHEN maker > 0 AND maker < filled THEN 1 ELSE 0 END) AS BIGINT) AS n_mixed_liquidity_runs FROM ex),
s AS (SELECT min(CASE WHEN s_suppkey % 2 = 0 THEN 'SYNTHETIC' ELSE 'CAPTURED' END) AS data_type, min(s_name) AS provenance, min('CC0-1.0') AS license, count(DISTINCT s_nationkey) AS n_config_fingerprints FROM supplier),
h AS (SELECT count(*) AS n_experiment_rows, CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_dirty_runs, count(DISTINCT c_mktsegment) AS n_git_commits FROM customer)
SELECT * FROM b, r, s, h"""

QUERIES = {
    "execution_summary": (execution_summary, SUMMARY),
    "benchmark_disagreement": (benchmark_disagreement, DISAGREEMENT),
    "cost_attribution": (cost_attribution, ATTRIBUTION),
    "run_attribution": (run_attribution, f"WITH {M.ATTRIBUTION} SELECT run_id, is_filled, shortfall, spread_cost, fees, timing, residual, opportunity, explained, n_without_mid, n_fills FROM an"),
    "markout_adverse_selection": (markout_adverse_selection, MARKOUT_SQL),
    "markout_summary": (markout_summary, MARKOUT_SUMMARY),
    "policy_sensitivity": (policy_sensitivity, SENSITIVITY),
    "fill_quality": (fill_quality, QUALITY),
    "data_quality_summary": (data_quality_summary, DATA_QUALITY),
}
