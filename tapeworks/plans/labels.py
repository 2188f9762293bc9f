"""Fill probability: labels, splits, scaling, simple and fitted models, their metrics and canaries."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.functions.tca import micro
from tapeworks.operators import asof, windows
from tapeworks.plans import books, research, series
from tapeworks.sources import market as M
from tapeworks.sources import shared

HORIZON = 10 * 3_600_000_000_000
GRID = 2 * 3_600_000_000_000
FEATURES = ("spread", "imbalance", "depth", "volume")
#: Shares of the training and validation blocks; the rest is the test.
SHARES, LEAST_SHARE = (6, 2, 2), 0.05


def market_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a policy may see after each event: the touch, the last trade of the window, running and
    recent volume by side, counts of book updates."""
    q = M.quotes(spark, sf_dir)
    trade = F.col("kind") == "TRADE"
    q = windows.known(q, ["symbol"], ["t", "seq"], {"last": F.when(trade, F.struct("t", "price", "qty", "side"))})
    q = windows.cumulative(q, ["symbol"], ["t", "seq"], {"market_volume": F.when(trade, F.col("qty")), "book_updates": F.when(F.col("kind").isin("ADD", "CANCEL"), F.lit(1).cast("long"))})
    fresh = F.col("last.t") >= F.col("t") - series.SPAN
    of = lambda c, v: F.when(c, v).otherwise(0)
    sums = {
        "recent_buy": of(trade & (F.col("side") == "BUY"), F.col("qty")),
        "recent_sell": of(trade & (F.col("side") == "SELL"), F.col("qty")),
        "recent_trades": of(trade, F.lit(1).cast("long")),
    }
    q = windows.trailing(q, ["symbol"], "t", "seq", series.SPAN, sums)
    return q.select("symbol", "seq", "t", "bid", "bid_qty", "ask", "ask_qty", "mid2", F.when(fresh, F.col("last.price")).alias("last_price"), F.when(fresh, F.col("last.qty")).otherwise(0).alias("last_qty"), "market_volume", "book_updates", *sums)


_RECENT = f"FROM ev b WHERE b.symbol = a.symbol AND b.t >= a.t - {series.SPAN} AND (b.t, b.seq) <= (a.t, a.seq) AND b.kind = 'TRADE'"
STATE = (
    M.QUOTES
    + f""",
lt AS (SELECT *, max(CASE WHEN kind = 'TRADE' THEN {{'t': t, 's': seq, 'price': price, 'qty': qty}} END) OVER w AS last, CAST(sum(CASE WHEN kind = 'TRADE' THEN qty ELSE 0 END) OVER w AS BIGINT) AS market_volume,
  CAST(sum(CASE WHEN kind IN ('ADD', 'CANCEL') THEN 1 ELSE 0 END) OVER w AS BIGINT) AS book_updates FROM qu WINDOW w AS (PARTITION BY symbol ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ms AS (SELECT symbol, seq, t, bid, bid_qty, ask, ask_qty, mid2, CASE WHEN last.t >= t - {series.SPAN} THEN last.price END AS last_price, CASE WHEN last.t >= t - {series.SPAN} THEN last.qty ELSE 0 END AS last_qty, market_volume, book_updates,
  CAST((SELECT coalesce(sum(CASE WHEN b.side = 'BUY' THEN b.qty END), 0) {_RECENT}) AS BIGINT) AS recent_buy, CAST((SELECT coalesce(sum(CASE WHEN b.side = 'SELL' THEN b.qty END), 0) {_RECENT}) AS BIGINT) AS recent_sell,
  (SELECT count(*) {_RECENT}) AS recent_trades FROM lt a)"""
)


def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole causal feature set at each two-sided event: touch, depth, flow, volatility, rates."""
    keys = ["symbol", "seq"]
    touch = series.microprice_imbalance(spark, sf_dir)
    ofi = series.rolling_ofi(spark, sf_dir).withColumnRenamed("ofi", "ofi_rolling")
    vol = series.realized_vol(spark, sf_dir)
    flow = series.rolling_flow(spark, sf_dir).withColumnRenamed("imbalance", "trade_imbalance").withColumn("signed_volume", F.col("buy") - F.col("sell"))
    return touch.join(ofi, keys).join(vol, keys).join(flow, keys)


def _ctes(sql: str, name: str) -> str:
    """A query's common tables as f_<name>."""
    return f"f_{name} AS ({sql})"


VECTOR = f"""WITH {_ctes(series.MICROPRICE, 'touch')}, {_ctes(series.ROLLING_OFI, 'ofi')}, {_ctes(series.VOL, 'vol')}, {_ctes(series.FLOW, 'flow')}
SELECT t.*, o.ofi AS ofi_rolling, v.vol, f.* EXCLUDE (symbol, seq, imbalance), f.imbalance AS trade_imbalance, f.buy - f.sell AS signed_volume
FROM f_touch t JOIN f_ofi o USING (symbol, seq) JOIN f_vol v USING (symbol, seq) JOIN f_flow f USING (symbol, seq)"""


def warm_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume in a window as an execution counts it: the running volume at its end less what it was
    before the begin, 0 at least."""
    trades = M.events(spark, sf_dir).where("kind = 'TRADE'").select("symbol", "t", "seq", "qty")
    found = asof.interval_sums(trades, series.spans(spark, sf_dir), ["symbol"], "t", "seq", "begin", "end", {"volume": F.col("qty")})
    return found.select("symbol", "run", F.greatest(F.lit(0), F.col("volume")).alias("volume"))


WARM = f"""WITH {M.EVENTS}, {series.SPANS} SELECT sp.symbol, run, CAST(coalesce(sum(qty), 0) AS BIGINT) AS volume FROM sp LEFT JOIN ev e ON e.symbol = sp.symbol AND e.kind = 'TRADE' AND e.t BETWEEN begin AND finish GROUP BY sp.symbol, run"""


def sampling_grid(frame: DataFrame, by: str, t: str, seq: str, interval: int) -> DataFrame:
    """The rows a sampler takes that, after each one, waits ``interval`` from that row's time.

    Which row is next depends on the row before, so a key's rows stream through one task in order;
    nothing but the last time is kept.
    """
    import pyarrow as pa

    def run(batches):
        key = due = None
        for batch in batches:
            keep = []
            for k, (b, at) in enumerate(zip(batch.column(batch.schema.get_field_index(by)).to_pylist(), batch.column(batch.schema.get_field_index(t)).to_pylist())):
                if b != key:
                    key, due = b, None
                if due is None or at >= due:
                    keep.append(k)
                    due = at + interval
            yield batch.take(pa.array(keep, pa.int64()))

    return frame.repartition(by).sortWithinPartitions(by, t, seq).mapInArrow(run, frame.schema)


def sampled_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = M.quotes(spark, sf_dir).where("mid2 IS NOT NULL").select("symbol", "t", "seq", "mid2")
    return sampling_grid(q, "symbol", "t", "seq", GRID)


SAMPLED = f"""WITH RECURSIVE {M.QUOTES}, q AS (SELECT symbol, t, seq, mid2 FROM qu WHERE mid2 IS NOT NULL),
g AS (SELECT symbol, min((t, seq)) AS at FROM q GROUP BY symbol
  UNION ALL SELECT g.symbol, (SELECT min((q.t, q.seq)) FROM q WHERE q.symbol = g.symbol AND q.t >= g.at[1] + {GRID}) AS at FROM g WHERE g.at IS NOT NULL)
SELECT q.* FROM g JOIN q ON q.symbol = g.symbol AND q.t = g.at[1] AND q.seq = g.at[2]"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled samples: at the first two-sided event of each hour a bid joins the back of its level;
    label 1 if trades of the horizon take more than the size ahead, 0 if not. Samples whose horizon
    ends after the last event are dropped unless already filled."""
    q = M.quotes(spark, sf_dir).where("mid2 IS NOT NULL")
    hour = F.col("t") - F.col("t") % series.HOUR
    first = q.groupBy("symbol", hour.alias("hour")).agg(F.min_by(F.struct("seq", "t", "bid", "ask", "bid_qty", "ask_qty"), F.struct("t", "seq")).alias("q")).select("symbol", "q.*")
    first = first.withColumn("level", F.floor(F.col("bid") / books.BAND).cast("long"))
    e = M.events(spark, sf_dir)
    sells = e.where("kind = 'TRADE' AND side = 'SELL'").select("symbol", F.floor(F.col("price") / books.BAND).cast("long").alias("level"), "t", "seq", "qty")
    s = first.withColumns({"begin": F.col("t") + 1, "end": F.col("t") + HORIZON})
    s = asof.interval_sums(sells, s, ["symbol", "level"], "t", "seq", "begin", "end", {"taken": F.col("qty")})
    last = F.broadcast(e.agg(F.max("t").alias("last")))  # one row
    s = s.crossJoin(last).withColumn("label", F.when(F.col("taken") > F.col("bid_qty"), 1).when(F.col("end") <= F.col("last"), 0)).where("label IS NOT NULL")
    total = F.col("bid_qty") + F.col("ask_qty")
    return s.select(
        "symbol",
        "seq",
        "t",
        (F.col("ask") - F.col("bid")).alias("spread"),
        F.when(F.col("seq") % 23 != 0, F.floor((F.col("bid_qty") - F.col("ask_qty")) * 1000 / total).cast("long")).alias("imbalance"),
        total.alias("depth"),
        F.col("bid_qty").alias("volume"),
        F.col("label").cast("long").alias("label"),
    )


LABELS = (
    M.QUOTES
    + f""",
fs AS (SELECT symbol, t - t % {series.HOUR} AS hour, arg_min({{'seq': seq, 't': t, 'bid': bid, 'ask': ask, 'bid_qty': bid_qty, 'ask_qty': ask_qty}}, (t, seq)) AS q FROM qu WHERE mid2 IS NOT NULL GROUP BY ALL),
fq AS (SELECT symbol, q.seq AS seq, q.t AS t, q.bid AS bid, q.ask AS ask, q.bid_qty AS bid_qty, q.ask_qty AS ask_qty, q.bid // {books.BAND} AS level FROM fs),
fk AS (SELECT fq.*, (SELECT coalesce(sum(e.qty), 0) FROM ev e WHERE e.kind = 'TRADE' AND e.side = 'SELL' AND e.symbol = fq.symbol AND e.price // {books.BAND} = fq.level AND e.t > fq.t AND e.t <= fq.t + {HORIZON}) AS taken FROM fq),
fb AS (SELECT *, CASE WHEN taken > bid_qty THEN 1 WHEN t + {HORIZON} <= (SELECT max(t) FROM ev) THEN 0 END AS label FROM fk),
sm AS (SELECT symbol, seq, t, ask - bid AS spread, CASE WHEN seq % 23 <> 0 THEN CAST(floor((bid_qty - ask_qty) * 1000 / (bid_qty + ask_qty)::DOUBLE) AS BIGINT) END AS imbalance, bid_qty + ask_qty AS depth, bid_qty AS volume, label::BIGINT AS label FROM fb WHERE label IS NOT NULL)"""
)


def embargo_rows(horizon: int, embargo: int, spacing: int) -> int:
    """Rows to leave out before a cut so that no label reaches over it."""
    if min(horizon, embargo) < 0 or spacing <= 0:
        raise ValueError("horizon and embargo can't be negative, spacing must be positive")
    return max(-(-horizon // spacing), -(-embargo // spacing))


def split(frame: DataFrame, by: list[str], order: list[str], gap: int, shares: tuple[int, ...] = SHARES) -> DataFrame:
    """``part`` of each row in time order: train, validation or test; ``gap`` rows before each cut are dropped."""
    whole = sum(shares)
    if len(shares) != 3 or whole <= 0 or min(shares) / whole < LEAST_SHARE:
        raise ValueError(f"three blocks of {LEAST_SHARE:.0%} at least, not {shares}")
    e = windows.numbered(frame, by, order)
    k, a, b = F.col("k"), F.floor(F.col("n") * shares[0] / whole), F.floor(F.col("n") * (shares[0] + shares[1]) / whole)
    part = F.when(k < a - gap, "train").when((k >= a) & (k < b - gap), "validation").when(k >= b, "test")
    return e.withColumn("part", part).where("part IS NOT NULL").drop("k", "n")


GAP = embargo_rows(HORIZON, GRID, series.HOUR)


def parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(samples(spark, sf_dir), ["symbol"], ["t", "seq"], GAP)


PARTED = f"""{LABELS}, sn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t, seq) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM sm),
pt AS (SELECT * EXCLUDE (k, n), CASE WHEN k < n * 6 // 10 - {GAP} THEN 'train' WHEN k >= n * 6 // 10 AND k < n * 8 // 10 - {GAP} THEN 'validation' WHEN k >= n * 8 // 10 THEN 'test' END AS part FROM sn),
pa AS (SELECT * FROM pt WHERE part IS NOT NULL)"""


def split_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and labels of each block, rows that two blocks share, and whether it begins after the one before ended."""
    p = parted(spark, sf_dir)
    twice = p.groupBy("symbol", "seq").agg(F.count_distinct("part").alias("parts")).groupBy("symbol").agg(F.sum(F.when(F.col("parts") > 1, 1).otherwise(0)).alias("shared"))
    b = p.groupBy("symbol", "part").agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    w = windows.Window.partitionBy("symbol").orderBy("first_t")  # three rows
    b = b.withColumn("in_order", F.coalesce(F.lag("last_t").over(w) < F.col("first_t"), F.lit(True)))
    return b.join(twice, "symbol").select("symbol", "part", "n", "positives", "in_order", "shared")


AUDIT = f"""WITH {PARTED}, b AS (SELECT symbol, part, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, min(t) AS first_t, max(t) AS last_t FROM pa GROUP BY symbol, part)
SELECT symbol, part, n, positives, coalesce(lag(last_t) OVER (PARTITION BY symbol ORDER BY first_t) < first_t, true) AS in_order, 0::BIGINT AS shared FROM b"""


def check_split(parts: DataFrame, keys: list[str]) -> None:
    """Raise if blocks share rows or are out of time order; both checks are aggregates in the cluster."""
    if parts.groupBy(*keys).agg(F.count_distinct("part").alias("p")).where("p > 1").limit(1).count():
        raise ValueError("blocks share rows")
    ends = {r["part"]: (r["a"], r["b"]) for r in parts.groupBy("part").agg(F.min("t").alias("a"), F.max("t").alias("b")).collect()}  # three rows
    order = [ends[p] for p in ("train", "validation", "test") if p in ends]
    if any(x[1] >= y[0] for x, y in zip(order, order[1:])):
        raise ValueError("blocks are out of time order")


def scaler(frame: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """One row: mean and population deviation of each feature over its non-null values; 1 for 0."""
    out = []
    for c in features:
        n, s1, s2 = F.count(c), F.sum(c), F.sum(F.col(c) * F.col(c))
        variance = (n * s2 - s1 * s1) / (n * n)
        out += [(s1 / n).alias(f"m_{c}"), F.when(variance > 0, F.sqrt(variance)).otherwise(F.lit(1.0)).alias(f"s_{c}")]
    return frame.agg(*out)


def standardise(frame: DataFrame, train: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """z_<feature>: by the training block's mean and deviation; null is the mean."""
    scaled = frame.crossJoin(F.broadcast(scaler(train, features)))  # one row
    z = {f"z_{c}": F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}"), F.lit(0.0)) for c in features}
    return scaled.withColumns(z).drop(*[f"{k}_{c}" for c in features for k in "ms"])


def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parted(spark, sf_dir)
    z = standardise(p, p.where("part = 'train'"))
    return z.groupBy("part").agg(F.count("*").alias("n"), *[micro(F.sum(F.floor(F.col(f"z_{c}") * 1e6 + 0.5).cast("long")) / F.count("*") / 1e6).alias(c) for c in FEATURES])


def _stat(c: str) -> str:
    return f"sum({c})::DOUBLE / count({c}) AS m_{c}, CASE WHEN count({c}) * sum({c} * {c}) - sum({c}) * sum({c}) > 0 THEN sqrt((count({c}) * sum({c} * {c}) - sum({c}) * sum({c}))::DOUBLE / (count({c}) * count({c}))::DOUBLE) ELSE 1.0 END AS s_{c}"


STANDARD = f"""WITH {PARTED}, st AS (SELECT {', '.join(_stat(c) for c in FEATURES)} FROM pa WHERE part = 'train')
SELECT part, count(*) AS n, {', '.join(f"CAST(floor(sum(CAST(floor(coalesce(({c} - m_{c}) / s_{c}, 0) * 1e6 + 0.5) AS BIGINT))::DOUBLE / count(*) / 1e6 * 1e6 + 0.5) AS BIGINT) AS {c}" for c in FEATURES)} FROM pa, st GROUP BY part"""


def report(scored: DataFrame, by: list[str], p: str = "p", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """Classification metrics in millionths: base rate, accuracy, hits and misses, precision, recall, F1, Brier, lift."""
    said, y = F.col(p) >= threshold, F.col(label) == 1
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    square = F.floor(F.pow(F.col(p) - F.col(label), F.lit(2.0)) * 1e9 + 0.5).cast("long")
    g = scored.groupBy(*by).agg(F.count("*").alias("n"), F.sum(label).alias("positives"), count(said & y).alias("tp"), count(said & ~y).alias("fp"), count(~said & y).alias("fn"), F.sum(square).alias("sq"))
    n, tp, fp, fn = F.col("n"), F.col("tp"), F.col("fp"), F.col("fn")
    share = lambda a, b: F.when(b > 0, micro(a / b)).otherwise(F.lit(0).cast("long"))
    right = n - fp - fn
    return g.select(
        *by,
        "n",
        share(F.col("positives"), n).alias("base_rate"),
        share(right, n).alias("accuracy"),
        "tp",
        "fp",
        "fn",
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        micro(F.col("sq") / 1e9 / n).alias("brier"),
        micro((right - F.col("positives")) / n).alias("lift"),
    )


def simple_models(train: DataFrame, rows: DataFrame, threshold: float = 0.0) -> DataFrame:
    """``rows`` scored by the base rate, and by a rule: twice the rate (1 at most) where the book does not lean to the bid."""
    rate = F.broadcast(train.agg((F.sum("label") / F.count("*")).alias("rate")))  # one row
    both = rows.crossJoin(rate)
    above = F.coalesce(F.col("imbalance") > threshold, F.lit(False))
    rule = F.when(~above, F.least(F.lit(1.0), F.col("rate") * 2)).otherwise(F.lit(0.0))
    return both.withColumn("m", F.explode(F.array(F.struct(F.lit("base_rate").alias("model"), F.col("rate").alias("p")), F.struct(F.lit("imbalance_threshold").alias("model"), rule.alias("p"))))).select(*rows.columns, "m.*")


def model_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two unfitted models, learned on the training block, on each block."""
    p = parted(spark, sf_dir)
    return report(simple_models(p.where("part = 'train'"), p), ["model", "part"])


REPORT = f"""WITH {PARTED}, ra AS (SELECT sum(label)::DOUBLE / count(*) AS rate FROM pa WHERE part = 'train'),
sc AS (SELECT pa.*, 'base_rate' AS model, rate AS p FROM pa, ra UNION ALL SELECT pa.*, 'imbalance_threshold', CASE WHEN coalesce(imbalance > 0, false) THEN 0 ELSE least(1.0::DOUBLE, rate * 2) END FROM pa, ra),
g AS (SELECT model, part, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(CASE WHEN p >= 0.5 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN p >= 0.5 AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN p < 0.5 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn, sum(CAST(floor(pow(p - label, 2.0) * 1e9 + 0.5) AS BIGINT)) AS sq FROM sc GROUP BY model, part)
SELECT model, part, n, CAST(floor(pos::DOUBLE / n * 1e6 + 0.5) AS BIGINT) AS base_rate, CAST(floor((n - fp - fn)::DOUBLE / n * 1e6 + 0.5) AS BIGINT) AS accuracy, tp, fp, fn,
  CASE WHEN tp + fp > 0 THEN CAST(floor(tp::DOUBLE / (tp + fp) * 1e6 + 0.5) AS BIGINT) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN CAST(floor(tp::DOUBLE / (tp + fn) * 1e6 + 0.5) AS BIGINT) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(floor((2 * tp)::DOUBLE / (2 * tp + fp + fn) * 1e6 + 0.5) AS BIGINT) ELSE 0 END AS f1, CAST(floor(sq::DOUBLE / 1e9 / n * 1e6 + 0.5) AS BIGINT) AS brier, CAST(floor((n - fp - fn - pos)::DOUBLE / n * 1e6 + 0.5) AS BIGINT) AS lift FROM g"""

CANARY_Z, LEAST_TOLERANCE = 2.5, 0.05


def null_tolerance(positives: Column, negatives: Column) -> Column:
    """How far an AUC may be from one half by chance: of the rank statistic's deviation, 0.05 at least."""
    error = F.sqrt((positives + negatives + 1) / (12.0 * positives * negatives))
    return F.when((positives > 0) & (negatives > 0), F.greatest(error * CANARY_Z, F.lit(LEAST_TOLERANCE))).otherwise(F.lit(LEAST_TOLERANCE))


def feature_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The AUC of each feature alone over the test block, with chance's tolerance and whether it leaks."""
    t = parted(spark, sf_dir).where("part = 'test'")
    long = t.select("label", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(c, F.lit(0)).alias("value")) for c in FEATURES])).alias("f")).select("label", "f.*")
    a = research.rank_auc(long, ["feature"], "value", "label")
    chance = F.abs(F.col("auc") - 500000) <= F.floor(null_tolerance(F.col("positives"), F.col("negatives")) * 1e6)
    return a.withColumns({"by_chance": chance, "leaks": (F.col("auc") >= 900000) | (F.col("auc") <= 100000)})


_UN = " UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce({c}, 0) AS value, label FROM pa WHERE part = 'test'" for c in FEATURES)
FEATURE_AUC = f"""WITH {PARTED}, un AS ({_UN}), rs AS ({research._auc_sql('un', 'feature', 'value').replace('r AS', 'WITH r AS', 1)} FROM g)
SELECT *, abs(auc - 500000) <= floor(greatest(sqrt((positives + negatives + 1)::DOUBLE / (12.0::DOUBLE * positives * negatives)) * {CANARY_Z}, {LEAST_TOLERANCE})::DOUBLE * 1e6) AS by_chance, auc >= 900000 OR auc <= 100000 AS leaks FROM rs"""


def _assembled(frame: DataFrame, features: tuple[str, ...]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=[f"z_{c}" for c in features], outputCol="features").transform(frame).withColumn("y", F.col("label").cast("double"))


def fit_scores(train: DataFrame, rows: DataFrame, model: str, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """``rows`` with p from a model fitted on ``train``: logistic (C = 1), mid (logistic on one
    feature), or ridge on the label, clipped to 0 and 1."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import LinearRegression

    used = features[:1] if model == "mid" else features
    x = _assembled(standardise(train, train, used), used).cache()
    try:
        n, spread = x.agg(F.count("*"), F.stddev_pop("y")).first()
        if model in ("logistic", "mid"):
            fitted = LogisticRegression(labelCol="y", regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, maxIter=100, tol=1e-9).fit(x)
        elif model == "ridge":
            fitted = LinearRegression(labelCol="y", solver="normal", regParam=1.0 / max(n, 1) * (spread or 1.0), elasticNetParam=0.0, standardization=False).fit(x)
        else:
            raise ValueError(f"model must be logistic, mid or ridge, not {model!r}")
    finally:
        x.unpersist()
    scored = fitted.transform(_assembled(standardise(rows, train, used), used))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction"))) if model == "ridge" else vector_to_array("probability")[1]
    return scored.select(*rows.columns, F.lit(model).alias("model"), p.alias("p"))


def shuffle_labels(frame: DataFrame, seed: int = 11) -> DataFrame:
    """The rows with the labels of other rows: both sides are numbered, labels in hashed order."""
    n = windows.numbered(frame.withColumn("__all", F.lit(0)), ["__all"], ["t", "symbol", "seq"])
    hashed = frame.select("label", (F.abs(F.xxhash64("symbol", "seq", F.lit(seed))) % (1 << 40)).alias("__h"), "symbol", "seq").withColumn("__all", F.lit(0))
    m = windows.numbered(hashed, ["__all"], ["__h", "symbol", "seq"], width=1 << 28).select(F.col("k"), F.col("label").alias("__label"))
    return n.join(m, "k").withColumn("label", F.col("__label")).select(frame.columns)


def ml_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models fitted on the training block and scored on validation; refitted on both and scored once
    on the test; and a canary, fitted on shuffled labels, that must not beat chance there."""
    p = shared.cut(parted(spark, sf_dir))
    train, validation, test = (p.where(F.col("part") == part) for part in ("train", "validation", "test"))
    both = train.unionByName(validation)
    shuffled = shared.cut(shuffle_labels(both))
    scored = None
    for model in ("logistic", "mid", "ridge"):
        for name, learn, rows in ((model, train, validation), (model, both, test), (f"{model}_canary", shuffled, test)):
            s = fit_scores(learn, rows, model).withColumn("model", F.lit(name))
            scored = s if scored is None else scored.unionByName(s)
    scored = scored.unionByName(simple_models(both, test))
    auc = research.rank_auc(scored, ["model", "part"], "p", "label")
    tolerance = F.floor(null_tolerance(F.col("positives"), F.col("negatives")) * 1e6).cast("long")
    auc = auc.select("model", "part", "auc", (F.abs(F.col("auc") - 500000) <= tolerance).alias("by_chance"))
    return report(scored, ["model", "part"]).join(auc, ["model", "part"])


QUERIES = {
    "market_state": (market_state, f"WITH {STATE} SELECT * FROM ms"),
    "feature_vector": (feature_vector, VECTOR),
    "warm_volume": (warm_volume, WARM),
    "sampling_grid": (sampled_states, SAMPLED),
    "fill_labels": (samples, f"WITH {LABELS} SELECT * FROM sm"),
    "split_audit": (split_audit, AUDIT),
    "standardised_features": (standardised, STANDARD),
    "model_report": (model_report, REPORT),
    "feature_auc": (feature_auc, FEATURE_AUC),
    "ml_pipeline": (ml_pipeline, None),
}
