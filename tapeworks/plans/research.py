"""Statistics and model scoring: resampling, tests, splits, ranks, calibration, linear fits."""

from __future__ import annotations

import math
import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.functions.tca import micro
from tapeworks.operators import windows
from tapeworks.sources import market as M


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled sample per run: features x1..x3 as small longs, label whether makers filled most."""
    x = M.executions(spark, sf_dir)
    return x.select(
        "run_id",
        (F.col("notional") / F.col("filled")).cast("long").alias("x1"),
        (F.col("n_fills") * 10 + F.col("run_id") % 3).alias("x2"),
        F.coalesce("arrival2", F.lit(0)).alias("x3"),
        F.when(F.col("maker") * 2 > F.col("filled"), 1).otherwise(0).alias("label"),
    )


SAMPLES = f"""{M.EXECUTIONS}, sa AS (SELECT run_id, CAST(trunc(notional::DOUBLE / filled) AS BIGINT) AS x1, n_fills * 10 + run_id % 3 AS x2, coalesce(arrival2, 0) AS x3, CASE WHEN maker * 2 > filled THEN 1 ELSE 0 END AS label FROM ex)"""


def _p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact two-sided sign test per policy and seed over all its runs: those above and below
    zero cost."""
    by = M.costs(spark, sf_dir).groupBy("policy", "seed").agg(F.sum(F.when(F.col("vs_arrival") > 0, 1).otherwise(0)).alias("wins"), F.sum(F.when(F.col("vs_arrival") < 0, 1).otherwise(0)).alias("losses"))
    return by.select("policy", "seed", "wins", "losses", micro(sign_test(F.col("wins"), F.col("losses"))).alias("p"))


def log_factorial(x: Column) -> Column:
    """ln x!: exact to 20, beyond by Stirling's series, whose first left-out term is under 1e-12 there."""
    y = x.cast("double")
    series = y * F.log(y) - y + F.log(y * (2 * math.pi)) / 2 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided p of so many wins and losses under equal chances; 1 without any. The tail is summed
    down from its greatest term, C(n, k), as far as terms can still count: some sqrt(n) of them."""
    n, k = wins + losses, F.least(wins, losses)
    first = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + n * F.lit(math.log(0.5))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def down(s: Column, i: Column) -> Column:
        term = F.when(i <= k, s["term"] * (k - i + 1) / (n - k + i)).otherwise(F.lit(0.0))
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    far = F.least(k, F.ceil(F.sqrt(n) * 10) + 50)
    ratio = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(far, F.lit(1)).cast("long")), start, down)["total"]
    return F.when(n > 0, F.least(F.lit(1.0), F.exp(first + F.log(ratio)) * 2)).otherwise(F.lit(1.0))


P_VALUES = f"""{M.COSTS}, wl AS (SELECT policy, seed, CAST(sum(CASE WHEN vs_arrival > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN vs_arrival < 0 THEN 1 ELSE 0 END) AS BIGINT) AS losses FROM co GROUP BY policy, seed),
nk AS (SELECT *, wins + losses AS n, least(wins, losses) AS k FROM wl),
pv AS (SELECT policy, seed, wins, losses, CASE WHEN n > 0 THEN CAST(floor(least(1.0::DOUBLE,
  2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5::DOUBLE))) FROM range(k + 1) AS t(i))) * 1e6 + 0.5) AS BIGINT) ELSE 1000000 END AS p FROM nk)"""


def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-down adjusted p over all comparisons, which are as many as policies and seeds."""
    w = Window.orderBy("p", "policy", "seed")
    m = F.count("*").over(Window.partitionBy())
    ranked = _p_values(spark, sf_dir).withColumn("scaled", (m - F.row_number().over(w) + 1) * F.col("p"))
    return ranked.select("policy", "seed", "p", F.least(F.lit(1_000_000), F.max("scaled").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("adjusted"))


HOLM = f"""WITH {P_VALUES}, r AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, policy, seed) + 1) * p AS scaled FROM pv)
SELECT policy, seed, p, least(1000000, max(scaled) OVER (ORDER BY p, policy, seed ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS adjusted FROM r"""


def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies against a baseline, paired by seed: wins, losses, ties and the mean difference."""
    c = M.costs(spark, sf_dir).groupBy("policy", "seed").agg(F.floor(F.sum("shortfall") / F.count("shortfall") + 0.5).cast("long").alias("cost"))
    base = c.where("policy = '1-URGENT'").select("seed", F.col("cost").alias("base"))
    d = c.where("policy <> '1-URGENT'").join(base, "seed").withColumn("d", F.col("cost") - F.col("base"))
    of = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    return d.groupBy("policy").agg(F.count("*").alias("pairs"), of(F.col("d") < 0).alias("wins"), of(F.col("d") > 0).alias("losses"), of(F.col("d") == 0).alias("ties"), F.floor(F.sum("d") / F.count("*") + 0.5).cast("long").alias("mean"))


PAIRED = f"""WITH {M.COSTS}, c AS (SELECT policy, seed, CAST(floor(sum(shortfall)::DOUBLE / count(shortfall) + 0.5) AS BIGINT) AS cost FROM co GROUP BY policy, seed),
d AS (SELECT c.policy, c.cost - b.cost AS d FROM c JOIN c b ON b.seed = c.seed AND b.policy = '1-URGENT' WHERE c.policy <> '1-URGENT')
SELECT policy, count(*) AS pairs, CAST(sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS losses, CAST(sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ties,
  CAST(floor(sum(d)::DOUBLE / count(*) + 0.5) AS BIGINT) AS mean FROM d GROUP BY policy"""


def purged_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous 60/20/20 blocks in time order per symbol with 5 rows dropped before each cut."""
    e = windows.numbered(M.events(spark, sf_dir).select("symbol", "seq", "t"), ["symbol"], ["t", "seq"])
    a, b = F.floor(F.col("n") * 6 / 10), F.floor(F.col("n") * 8 / 10)
    k = F.col("k")
    part = F.when(k < a - 5, "train").when((k >= a) & (k < b - 5), "validation").when(k >= b, "test")
    return e.select("symbol", part.alias("part")).where("part IS NOT NULL").groupBy("symbol", "part").agg(F.count("*").alias("n"))


SPLIT = f"""WITH {M.EVENTS}, k AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY t, seq) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM ev),
p AS (SELECT symbol, CASE WHEN k < n * 6 // 10 - 5 THEN 'train' WHEN k >= n * 6 // 10 AND k < n * 8 // 10 - 5 THEN 'validation' WHEN k >= n * 8 // 10 THEN 'test' END AS part FROM k)
SELECT symbol, part, count(*) AS n FROM p WHERE part IS NOT NULL GROUP BY symbol, part"""


def rank_auc(scored: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Area under the curve by average ranks (in halves, so sums are exact). Ties are counted
    before anything is ranked, so the window runs over distinct scores."""
    ties = scored.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(label).alias("pos"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    r = ties.withColumn("rank2", 2 * F.sum("n").over(w) - F.col("n") + 1)
    g = r.groupBy(*by).agg(F.sum(F.col("rank2") * F.col("pos")).alias("s"), F.sum("pos").alias("p"), F.sum("n").alias("t"))
    p, q = F.col("p"), F.col("t") - F.col("p")
    return g.select(*by, p.alias("positives"), q.alias("negatives"), F.when((p > 0) & (q > 0), micro((F.col("s") - p * (p + 1)) / (2 * p * q))).alias("auc"))


def feature_leak_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The AUC of each feature alone, flagged from 0.90 on either side."""
    s = _samples(spark, sf_dir).selectExpr("label", "stack(3, 'x1', x1, 'x2', x2, 'x3', x3) AS (feature, value)")
    return rank_auc(s, ["feature"], "value", "label").withColumn("leaks", (F.col("auc") >= 900000) | (F.col("auc") <= 100000))


def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir).withColumn("fold", F.col("run_id") % 4)
    return rank_auc(s, ["fold"], "x2", "label")


def _auc_sql(source: str, by: str, score: str) -> str:
    return f"""r AS (SELECT {by}, label, 2 * rank() OVER (PARTITION BY {by} ORDER BY {score}) + count(*) OVER (PARTITION BY {by}, {score}) - 1 AS rank2 FROM {source}),
g AS (SELECT {by}, sum(CASE WHEN label = 1 THEN rank2 ELSE 0 END) AS s, sum(label) AS p, count(*) - sum(label) AS q FROM r GROUP BY {by})
SELECT {by}, CAST(p AS BIGINT) AS positives, CAST(q AS BIGINT) AS negatives, CASE WHEN p > 0 AND q > 0 THEN CAST(floor((s - p * (p + 1))::DOUBLE / (2 * p * q)::DOUBLE * 1e6 + 0.5) AS BIGINT) END AS auc"""


LEAK = f"""WITH {SAMPLES}, un AS (SELECT label, 'x1' AS feature, x1 AS value FROM sa UNION ALL SELECT label, 'x2', x2 FROM sa UNION ALL SELECT label, 'x3', x3 FROM sa), {_auc_sql('un', 'feature', 'value')},
  (CASE WHEN p > 0 AND q > 0 THEN CAST(floor((s - p * (p + 1))::DOUBLE / (2 * p * q)::DOUBLE * 1e6 + 0.5) AS BIGINT) END) >= 900000 OR (CASE WHEN p > 0 AND q > 0 THEN CAST(floor((s - p * (p + 1))::DOUBLE / (2 * p * q)::DOUBLE * 1e6 + 0.5) AS BIGINT) END) <= 100000 AS leaks FROM g"""
AUC = f"WITH {SAMPLES}, fo AS (SELECT *, run_id % 4 AS fold FROM sa), {_auc_sql('fo', 'fold', 'x2')} FROM g"


def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir).withColumn("p", F.col("run_id") % 101 / 100)
    return s.groupBy(F.least(F.floor(F.col("p") * 10 + 1e-9), F.lit(9)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.sum(F.col("run_id") % 101).alias("sum_p"))


CALIBRATION = f"""WITH {SAMPLES} SELECT CAST(least(floor((run_id % 101)::DOUBLE / 100 * 10 + 1e-9), 9) AS BIGINT) AS bin, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, CAST(sum(run_id % 101) AS BIGINT) AS sum_p FROM sa GROUP BY ALL"""


def paired_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of a rule less that of the majority class, with its standard error."""
    s = _samples(spark, sf_dir).withColumn("d", F.when((F.col("x2") > 40) == (F.col("label") == 1), 1).otherwise(0) - F.col("label"))
    n, s1, s2 = F.count("*"), F.sum("d"), F.sum(F.col("d") * F.col("d"))
    error = F.when(n > 1, micro(F.sqrt((n * s2 - s1 * s1) / (n * (n - 1)) / n)))
    return s.agg(n.alias("n"), micro(s1 / n).alias("lift"), error.alias("error"))


LIFT = f"""WITH {SAMPLES}, d AS (SELECT CASE WHEN (x2 > 40) = (label = 1) THEN 1 ELSE 0 END - label AS d FROM sa), g AS (SELECT count(*) AS n, sum(d) AS s1, sum(d * d) AS s2 FROM d)
SELECT n, CAST(floor(s1::DOUBLE / n * 1e6 + 0.5) AS BIGINT) AS lift, CAST(floor(sqrt((n * s2 - s1 * s1)::DOUBLE / (n * (n - 1))::DOUBLE / n) * 1e6 + 0.5) AS BIGINT) AS error FROM g"""


def block_bootstrap(spark: SparkSession, sf_dir: str, resamples: int = 200, block: int = 5) -> DataFrame:
    """Moving-block bootstrap of each policy's mean cost over seed-ordered means; a policy has few."""
    series = M.costs(spark, sf_dir).groupBy("policy", (F.col("run_id") % 40).alias("k")).agg((F.sum("shortfall") / F.count("*")).alias("v"))
    per = series.groupBy("policy").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("values"))  # 40 values at most

    def run(batches):
        for batch in batches:
            out = []
            for policy, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                draw, n = random.Random(f"11:{policy}"), len(values)
                size = min(block, n)
                means = []
                for _ in range(resamples):
                    picked: list[float] = []
                    for _ in range(math.ceil(n / size)):
                        a = draw.randrange(n - size + 1)
                        picked += values[a : a + size]
                    means.append(sum(picked[:n]) / n)
                means.sort()
                mean = sum(values) / n
                low, high = means[int(0.025 * (resamples - 1))], means[math.ceil(0.975 * (resamples - 1))]
                out.append((policy, n, mean, min(low, mean), max(high, mean)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], type=t) for k, t in enumerate((pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], names=["policy", "n", "mean", "low", "high"])

    return per.mapInArrow(run, "policy string, n long, mean double, low double, high double")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    s = _samples(spark, sf_dir)
    m = s.agg(*[f(c).alias(f"{n}_{c}") for c in ("x1", "x2", "x3") for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = s.crossJoin(F.broadcast(m))  # one row
    for c in ("x1", "x2", "x3"):
        scaled = scaled.withColumn(f"z_{c}", F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0))
    return VectorAssembler(inputCols=["z_x1", "z_x2", "z_x3"], outputCol="features").transform(scaled).withColumn("y", F.col("label").cast("double"))


def _coefficients(spark: SparkSession, model, n: int) -> DataFrame:
    values = [("intercept", float(model.intercept)), *[(f"x{k + 1}", float(v)) for k, v in enumerate(model.coefficients)]]
    return spark.createDataFrame([(name, v, n) for name, v in values], "term string, value double, n long")


def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 logistic regression, C = 1 on the summed loss."""
    from pyspark.ml.classification import LogisticRegression

    x = _features(spark, sf_dir)
    n = x.count()
    return _coefficients(spark, LogisticRegression(labelCol="y", regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, maxIter=100, tol=1e-9).fit(x), n)


def ridge_fit(spark: SparkSession, sf_dir: str, alpha: float = 1.0) -> DataFrame:
    """Least squares with an L2 penalty of alpha on the summed squares, by normal equations."""
    from pyspark.ml.regression import LinearRegression

    x = _features(spark, sf_dir)
    n, spread = x.agg(F.count("*"), F.stddev_pop("y")).first()
    return _coefficients(spark, LinearRegression(labelCol="y", solver="normal", regParam=alpha / max(n, 1) * (spread or 1.0), elasticNetParam=0.0, standardization=False).fit(x), n)


QUERIES = {
    "sign_test": (_p_values, f"WITH {P_VALUES} SELECT * FROM pv"),
    "holm_adjust": (holm_adjust, HOLM),
    "paired_difference": (paired_difference, PAIRED),
    "purged_split": (purged_split, SPLIT),
    "auc_rank": (auc_rank, AUC),
    "feature_leak_screen": (feature_leak_screen, LEAK),
    "calibration_bins": (calibration_bins, CALIBRATION),
    "paired_lift": (paired_lift, LIFT),
    "block_bootstrap": (block_bootstrap, None),
    "logistic_fit": (logistic_fit, None),
    "ridge_fit": (ridge_fit, None),
}
