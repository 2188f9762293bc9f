"""Benchmarks over time windows, as-of lookups and causal features of the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.functions.tca import micro, square_root_impact
from tapeworks.operators import asof, windows
from tapeworks.sources import market as M

DAY = 86_400_000_000_000
SPAN = 21_600_000_000_000  # six hours
HOUR = 3_600_000_000_000


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's window from each ADD."""
    return M.events(spark, sf_dir).where("kind = 'ADD'").select("symbol", F.col("seq").alias("run"), F.col("t").alias("begin"), (F.col("t") + DAY).alias("end"), "side", F.col("price").alias("own"))


SPANS = f"sp AS (SELECT symbol, seq AS run, t AS begin, t + {DAY} AS finish, side, price AS own FROM ev WHERE kind = 'ADD')"


def interval_vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = M.events(spark, sf_dir).where("kind = 'TRADE' AND price > 0 AND qty > 0").select("symbol", "t", "seq", "price", "qty")
    sums = {"n_prints": F.lit(1).cast("long"), "volume": F.col("qty"), "notional": (F.col("price") * F.col("qty")).cast("decimal(38,0)")}
    found = asof.interval_sums(trades, spans(spark, sf_dir), ["symbol"], "t", "seq", "begin", "end", sums)
    return found.where("n_prints > 0").select("symbol", "run", "n_prints", "volume", micro(F.col("notional").cast("double") / F.col("volume")).alias("vwap"))


VWAP = f"""WITH {M.EVENTS}, {SPANS}
SELECT sp.symbol, run, count(*) AS n_prints, CAST(sum(qty) AS BIGINT) AS volume, CAST(floor(sum(price * qty)::DOUBLE / sum(qty)::DOUBLE * 1e6 + 0.5) AS BIGINT) AS vwap
FROM sp JOIN ev e ON e.symbol = sp.symbol AND e.t BETWEEN begin AND finish WHERE kind = 'TRADE' AND e.price > 0 AND qty > 0 GROUP BY sp.symbol, run"""


def _mids_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that have mids, with the first and the last of them and the sums up to each."""
    mids = M.quotes(spark, sf_dir).where("mid2 IS NOT NULL").select("symbol", "t", "seq", "mid2")
    mids = windows.previous(mids, ["symbol"], ["t", "seq"], ["t", "mid2"])
    area = (F.col("mid2") + F.col("p_mid2")).cast("decimal(38,0)") * (F.col("t") - F.col("p_t"))
    sums = {"n": F.lit(1).cast("long"), "total": F.col("mid2"), "area": F.coalesce(area.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))}
    known = windows.cumulative(mids, ["symbol"], ["t", "seq"], sums).select("symbol", "t", "seq", F.struct("t", "mid2", *sums).alias("at"))
    last = asof.asof_join(spans(spark, sf_dir), known, ["symbol"], "end", "t", "seq", ["at"]).withColumnRenamed("at", "last")
    both = asof.asof_join(last, known, ["symbol"], "begin", "t", "seq", ["at"], "forward").withColumnRenamed("at", "first")
    return both.where("first.t <= end").withColumn("n_mids", F.col("last.n") - F.col("first.n") + 1)


MIDS_IN = f"{M.QUOTES}, {SPANS}, mi AS (SELECT sp.*, q.t, q.seq, q.mid2 FROM sp JOIN qu q ON q.symbol = sp.symbol AND q.t BETWEEN begin AND finish WHERE mid2 IS NOT NULL)"


def interval_twap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trapezoid over the mids of the window; null under two times."""
    area = (F.col("last.area") - F.col("first.area")).cast("double")
    width = F.col("last.t") - F.col("first.t")
    return _mids_in(spark, sf_dir).select("symbol", "run", "n_mids", F.when(width > 0, micro(area / (width.cast("double") * 4))).alias("twap"))


TWAP = f"""WITH {MIDS_IN}, st AS (SELECT *, lead(t) OVER w AS t2, lead(mid2) OVER w AS m2 FROM mi WINDOW w AS (PARTITION BY symbol, run ORDER BY t, seq))
SELECT symbol, run, count(*) AS n_mids, CASE WHEN max(t) > min(t) THEN CAST(floor(sum((mid2 + m2)::HUGEINT * (t2 - t))::DOUBLE / ((max(t) - min(t))::DOUBLE * 4) * 1e6 + 0.5) AS BIGINT) END AS twap
FROM st GROUP BY symbol, run"""


def arrival_terminal_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.col("last.total") - F.col("first.total") + F.col("first.mid2")
    return _mids_in(spark, sf_dir).select("symbol", "run", F.col("first.mid2").alias("arrival2"), F.col("last.mid2").alias("terminal2"), micro(total / F.col("n_mids") / 2).alias("mean_mid"), "n_mids")


ARRIVAL = f"""WITH {MIDS_IN}
SELECT symbol, run, arg_min(mid2, (t, seq)) AS arrival2, arg_max(mid2, (t, seq)) AS terminal2, CAST(floor(sum(mid2)::DOUBLE / count(*) / 2 * 1e6 + 0.5) AS BIGINT) AS mean_mid, count(*) AS n_mids
FROM mi GROUP BY symbol, run"""


def _asof(direction: str, inclusive: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = M.quotes(spark, sf_dir)
        hour = lambda c: F.col(c) - F.col(c) % HOUR
        probes = q.where("kind = 'TRADE'").select("symbol", F.col("seq").alias("probe"), hour("t").alias("at"))
        mids = q.where("mid2 IS NOT NULL").select("symbol", hour("t").alias("mt"), F.col("seq").alias("mseq"), "mid2")
        return asof.asof_join(probes, mids, ["symbol"], "at", "mt", "mseq", ["mid2", "mseq"], direction, inclusive)

    sign = {("backward", True): "<=", ("backward", False): "<", ("forward", True): ">="}[direction, inclusive]
    pick = "arg_max" if direction == "backward" else "arg_min"
    sql = f"""WITH {M.QUOTES}, h AS (SELECT *, t - t % {HOUR} AS ht FROM qu)
SELECT p.symbol, p.seq AS probe, p.ht AS at, {pick}(m.mid2, (m.ht, m.seq)) AS mid2, {pick}(m.seq, (m.ht, m.seq)) AS mseq
FROM h p LEFT JOIN h m ON m.symbol = p.symbol AND m.mid2 IS NOT NULL AND m.ht {sign} p.ht WHERE p.kind = 'TRADE' GROUP BY ALL"""
    return query, sql


def implementation_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.costs(spark, sf_dir).select("run_id", "requested", "filled", "shortfall")


def fees_bps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.costs(spark, sf_dir).select("run_id", "fees_requested", "fees")


def signed_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.costs(spark, sf_dir).select("run_id", "side", "vs_arrival", "vs_vwap", "vs_twap", "vs_terminal")


def _touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided events with the touch before each."""
    return windows.previous(M.quotes(spark, sf_dir).where("mid2 IS NOT NULL"), ["symbol"], ["t", "seq"], ["bid", "bid_qty", "ask", "ask_qty", "mid2"])


def _ofi():
    c = F.col
    bid = F.when(c("bid") > c("p_bid"), c("bid_qty")).when(c("bid") < c("p_bid"), -c("p_bid_qty")).otherwise(c("bid_qty") - c("p_bid_qty"))
    ask = F.when(c("ask") < c("p_ask"), c("ask_qty")).when(c("ask") > c("p_ask"), -c("p_ask_qty")).otherwise(c("ask_qty") - c("p_ask_qty"))
    return F.when(c("p_bid").isNotNull(), bid - ask)


TOUCH = (
    M.QUOTES
    + """,
tc AS (SELECT *, lag(bid) OVER w AS p_bid, lag(bid_qty) OVER w AS p_bid_qty, lag(ask) OVER w AS p_ask, lag(ask_qty) OVER w AS p_ask_qty, lag(mid2) OVER w AS p_mid2
  FROM qu WHERE mid2 IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY t, seq)),
of AS (SELECT *, CASE WHEN p_bid IS NOT NULL THEN
   (CASE WHEN bid > p_bid THEN bid_qty WHEN bid < p_bid THEN -p_bid_qty ELSE bid_qty - p_bid_qty END)
   - (CASE WHEN ask < p_ask THEN ask_qty WHEN ask > p_ask THEN -p_ask_qty ELSE ask_qty - p_ask_qty END) END AS ofi FROM tc)"""
)


def event_ofi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _touch(spark, sf_dir).select("symbol", "seq", _ofi().alias("ofi"))


def _minute(frame: DataFrame) -> DataFrame:
    """Coarser times, so that many events share one and the causal frame matters."""
    return frame.withColumn("t", F.col("t") - F.col("t") % (HOUR * 2))


def rolling_ofi(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _minute(_touch(spark, sf_dir).withColumn("ofi", F.coalesce(_ofi(), F.lit(0))))
    return windows.trailing(x.select("symbol", "seq", "t", F.col("ofi").alias("own")), ["symbol"], "t", "seq", SPAN, {"ofi": F.col("own")}).select("symbol", "seq", "ofi")


def _trailing_sql(value: str, name: str) -> str:
    return f"""CAST((SELECT coalesce(sum({value}), 0) FROM z b WHERE b.symbol = a.symbol AND b.t >= a.t - {SPAN} AND (b.t, b.seq) <= (a.t, a.seq)) AS BIGINT) AS {name}"""


ROLLING_OFI = f"""WITH {TOUCH}, z AS (SELECT symbol, seq, t - t % {HOUR * 2} AS t, coalesce(ofi, 0) AS ofi FROM of)
SELECT symbol, seq, {_trailing_sql('b.ofi', 'ofi')} FROM z a"""


def realized_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square root of the window's squared log returns, in bps; the squares summed in 1e-12."""
    r = F.log(F.col("mid2") / F.col("p_mid2"))
    square = F.when(F.col("p_mid2") > 0, F.floor(r * r * F.lit(1e12) + F.lit(0.5)).cast("long"))
    x = _minute(_touch(spark, sf_dir).withColumn("sq", F.coalesce(square, F.lit(0))))
    x = windows.trailing(x.select("symbol", "seq", "t", "sq"), ["symbol"], "t", "seq", SPAN, {"total": F.col("sq")})
    return x.select("symbol", "seq", micro(F.sqrt(F.col("total") / F.lit(1e12)) * 1e4).alias("vol"))


VOL = f"""WITH {TOUCH}, z AS (SELECT symbol, seq, t - t % {HOUR * 2} AS t,
  CASE WHEN p_mid2 > 0 THEN CAST(floor(ln(mid2::DOUBLE / p_mid2) * ln(mid2::DOUBLE / p_mid2) * 1e12 + 0.5) AS BIGINT) ELSE 0 END AS sq FROM tc),
s AS (SELECT symbol, seq, {_trailing_sql('b.sq', 'total')} FROM z a)
SELECT symbol, seq, CAST(floor(sqrt(total / 1e12::DOUBLE) * 1e4 * 1e6 + 0.5) AS BIGINT) AS vol FROM s"""


def rolling_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda cond, v: F.when(cond, v).otherwise(0)
    trade = F.col("kind") == "TRADE"
    sums = {
        "buy": of(trade & (F.col("side") == "BUY"), F.col("qty")),
        "sell": of(trade & (F.col("side") == "SELL"), F.col("qty")),
        "trades": of(trade, F.lit(1)),
        "adds": of(F.col("kind") == "ADD", F.lit(1)),
        "cancels": of(F.col("kind") == "CANCEL", F.lit(1)),
    }
    x = windows.trailing(_minute(M.events(spark, sf_dir)), ["symbol"], "t", "seq", SPAN, sums).select("symbol", "seq", *sums)
    rates = {f"{c}_per_s": micro(F.col(c) / F.lit(SPAN / 1e9)) for c in ("trades", "adds", "cancels")}
    x = x.withColumns(rates)
    total = F.col("buy") + F.col("sell")
    return x.withColumn("imbalance", F.when(total > 0, micro((F.col("buy") - F.col("sell")) / total)))


FLOW = f"""WITH {M.EVENTS}, z AS (SELECT symbol, seq, t - t % {HOUR * 2} AS t, kind, side, qty FROM ev),
s AS (SELECT symbol, seq, {_trailing_sql("CASE WHEN b.kind = 'TRADE' AND b.side = 'BUY' THEN b.qty END", 'buy')}, {_trailing_sql("CASE WHEN b.kind = 'TRADE' AND b.side = 'SELL' THEN b.qty END", 'sell')},
  {_trailing_sql("CASE WHEN b.kind = 'TRADE' THEN 1 END", 'trades')}, {_trailing_sql("CASE WHEN b.kind = 'ADD' THEN 1 END", 'adds')}, {_trailing_sql("CASE WHEN b.kind = 'CANCEL' THEN 1 END", 'cancels')} FROM z a)
SELECT *, {', '.join(f"CAST(floor({c} / {SPAN / 1e9!r}::DOUBLE * 1e6 + 0.5) AS BIGINT) AS {c}_per_s" for c in ('trades', 'adds', 'cancels'))},
  CASE WHEN buy + sell > 0 THEN CAST(floor((buy - sell)::DOUBLE / (buy + sell) * 1e6 + 0.5) AS BIGINT) END AS imbalance FROM s"""


def cumulative_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    traded = F.when(F.col("kind") == "TRADE", F.col("qty")).otherwise(0)
    updates = F.when(F.col("kind").isin("ADD", "CANCEL"), 1).otherwise(0)
    return windows.cumulative(M.events(spark, sf_dir), ["symbol"], ["t", "seq"], {"volume": traded, "book_updates": updates}).select("symbol", "seq", "volume", F.col("book_updates").cast("long").alias("book_updates"))


CUMULATIVE = f"""WITH {M.EVENTS} SELECT symbol, seq, CAST(sum(CASE WHEN kind = 'TRADE' THEN qty ELSE 0 END) OVER w AS BIGINT) AS volume, CAST(sum(CASE WHEN kind IN ('ADD', 'CANCEL') THEN 1 ELSE 0 END) OVER w AS BIGINT) AS book_updates
FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def last_trade_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    trade = F.when(F.col("kind") == "TRADE", F.struct("t", "price", "qty", "side"))
    x = windows.known(M.events(spark, sf_dir), ["symbol"], ["t", "seq"], {"last": trade})
    fresh = F.col("last.t") >= F.col("t") - SPAN
    return x.select("symbol", "seq", *[F.when(fresh, F.col(f"last.{c}")).alias(f"last_{c}") for c in ("price", "qty", "side")])


LAST_TRADE = f"""WITH {M.EVENTS}, l AS (SELECT *, max(CASE WHEN kind = 'TRADE' THEN {{'t': t, 's': seq, 'price': price, 'qty': qty, 'side': side}} END) OVER (PARTITION BY symbol ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM ev)
SELECT symbol, seq, CASE WHEN last.t >= t - {SPAN} THEN last.price END AS last_price, CASE WHEN last.t >= t - {SPAN} THEN last.qty END AS last_qty, CASE WHEN last.t >= t - {SPAN} THEN last.side END AS last_side FROM l"""


def microprice_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    size = c("bid_qty") + c("ask_qty")
    q = M.quotes(spark, sf_dir).where("mid2 IS NOT NULL")
    return q.select(
        "symbol",
        "seq",
        (c("ask") - c("bid")).alias("spread"),
        F.when(c("mid2") > 0, micro((c("ask") - c("bid")) / (c("mid2") / 2) * 1e4)).alias("spread_bps"),
        micro((c("bid") * c("ask_qty") + c("ask") * c("bid_qty")) / size).alias("microprice"),
        micro((c("bid_qty") - c("ask_qty")) / size).alias("imbalance"),
        (c("bid") > c("ask")).alias("crossed"),
        (c("bid") == c("ask")).alias("locked"),
    )


MICROPRICE = f"""WITH {M.QUOTES}
SELECT symbol, seq, ask - bid AS spread, CASE WHEN mid2 > 0 THEN CAST(floor((ask - bid) / (mid2::DOUBLE / 2) * 1e4 * 1e6 + 0.5) AS BIGINT) END AS spread_bps,
  CAST(floor((bid * ask_qty + ask * bid_qty)::DOUBLE / (bid_qty + ask_qty) * 1e6 + 0.5) AS BIGINT) AS microprice, CAST(floor((bid_qty - ask_qty)::DOUBLE / (bid_qty + ask_qty) * 1e6 + 0.5) AS BIGINT) AS imbalance,
  bid > ask AS crossed, bid = ask AS locked
FROM qu WHERE mid2 IS NOT NULL"""


def impact_sqrt(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = M.executions(spark, sf_dir)
    rate = F.col("filled") / (F.col("requested") + 100)
    sigma = (F.col("run_id") % 50).cast("double")
    return x.select("run_id", micro(square_root_impact(sigma, rate, 0.7, 0.5, 20.0)).alias("impact"))


IMPACT = f"""WITH {M.EXECUTIONS} SELECT run_id, CAST(floor(least(greatest(0.7::DOUBLE * (run_id % 50) * sqrt(filled::DOUBLE / (requested + 100)), 0.5), 20.0)::DOUBLE * 1e6 + 0.5) AS BIGINT) AS impact FROM ex"""

MAX_EVENTS = 50


def replay_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first events of each session, as many as a replay with a limit would take."""
    e = windows.numbered(M.events(spark, sf_dir), ["symbol"], ["t", "seq"])
    return e.where(F.col("k") < MAX_EVENTS).select("symbol", "k", "seq", "kind", "price", "qty")


PREFIX = f"""WITH {M.EVENTS} SELECT symbol, k, seq, kind, price, qty FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t, seq) - 1 AS k FROM ev) WHERE k < {MAX_EVENTS}"""

QUERIES = {
    "replay_prefix": (replay_prefix, PREFIX),
    "interval_vwap": (interval_vwap, VWAP),
    "interval_twap": (interval_twap, TWAP),
    "arrival_terminal_mid": (arrival_terminal_mid, ARRIVAL),
    "asof_backward_inclusive": _asof("backward", True),
    "asof_backward_strict": _asof("backward", False),
    "asof_forward": _asof("forward", True),
    "implementation_shortfall": (implementation_shortfall, f"WITH {M.COSTS} SELECT run_id, requested, filled, shortfall FROM co"),
    "fees_bps": (fees_bps, f"WITH {M.COSTS} SELECT run_id, fees_requested, fees FROM co"),
    "signed_cost": (signed_cost, f"WITH {M.COSTS} SELECT run_id, side, vs_arrival, vs_vwap, vs_twap, vs_terminal FROM co"),
    "event_ofi": (event_ofi, f"WITH {TOUCH} SELECT symbol, seq, ofi FROM of"),
    "rolling_ofi": (rolling_ofi, ROLLING_OFI),
    "realized_vol": (realized_vol, VOL),
    "rolling_flow": (rolling_flow, FLOW),
    "cumulative_volume": (cumulative_volume, CUMULATIVE),
    "last_trade_window": (last_trade_window, LAST_TRADE),
    "microprice_imbalance": (microprice_imbalance, MICROPRICE),
    "impact_sqrt": (impact_sqrt, IMPACT),
}
