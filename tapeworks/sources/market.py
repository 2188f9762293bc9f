"""The market model over the star-schema tables: executions, fills, costs, markouts, event stream.

Times are long nanoseconds, prices long ticks, quantities long units. The SQL constants say the
same for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.functions import tca
from tapeworks.operators import windows

HORIZONS = (1, 10, 60)
#: Event times as nanoseconds need UTC wall clocks.
ZONE = "UTC"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", ZONE)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanos(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")) * 1000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, seq, t, kind (BID, ASK, TRADE, ADD, CANCEL), side, price, qty."""
    kind = F.when(F.col("event_type") == "click", "BID").when(F.col("event_type") == "view", "ASK").when(F.col("event_type") == "purchase", "TRADE").when(F.col("event_type") == "signup", "ADD").otherwise("CANCEL")
    return read(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("symbol"),
        F.col("event_id").alias("seq"),
        nanos("ts").alias("t"),
        kind.alias("kind"),
        F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        F.floor(F.col("value") * 100 + 0.5).cast("long").alias("price"),
        (1 + F.col("event_id") % 100).alias("qty"),
    )


EVENTS = """ev AS (
  SELECT user_id % 10 AS symbol, event_id AS seq, epoch_us(ts) * 1000 AS t,
         CASE event_type WHEN 'click' THEN 'BID' WHEN 'view' THEN 'ASK' WHEN 'purchase' THEN 'TRADE' WHEN 'signup' THEN 'ADD' ELSE 'CANCEL' END AS kind,
         CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
         CAST(floor(value * 100 + 0.5) AS BIGINT) AS price, 1 + event_id % 100 AS qty
  FROM events)"""


DAY = 86_400_000_000_000
#: A run's window: from its order on, both ends in. No print is later than this after its order.
WINDOW_DAYS = 120


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, side, price, qty, liquidity, fee, t."""
    lines = read(spark, sf_dir, "lineitem")
    own = lines.select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").alias("fill"),
        F.col("l_partkey"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5).cast("long").alias("price"),
        F.col("l_quantity").cast("long").alias("qty"),
        F.when(F.col("l_returnflag") == "N", "MAKER").otherwise("TAKER").alias("liquidity"),
        tca.micro(F.col("l_extendedprice") * (F.col("l_tax") - F.col("l_discount") / 10)).alias("fee_micro"),
        nanos("l_shipdate").alias("t"),
    )
    return own.join(runs(spark, sf_dir), "run_id")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent orders: run_id, symbol, seed, policy, side, start, and how they were simulated."""
    policy, mode = F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 3 == 0, "EXACT").otherwise("APPROXIMATE")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        (F.col("o_custkey") % 10).alias("symbol"),
        (F.col("o_custkey") % 5).alias("seed"),
        policy.alias("policy"),
        F.when(F.col("o_orderstatus").isin("F", "P"), "BUY").otherwise("SELL").alias("side"),
        nanos("o_orderdate").alias("start"),
        mode.alias("queue_mode"),
        F.when(F.col("o_custkey") % 2 == 0, "CONSTANT").otherwise("OBSERVED").alias("latency_basis"),
        F.lit("NO_IMPACT").alias("counterfactual_mode"),
        fingerprint(F.concat(F.lit('{"policy": "'), policy, F.lit('", "queue_mode": "'), mode, F.lit('"}'))).alias("config_fingerprint"),
    )


def fingerprint(config) -> Column:
    """The first 16 hex digits of the sha256 of a configuration's sorted JSON."""
    return F.substring(F.sha2(config, 256), 1, 16)


FILLS = """fl AS (
  SELECT l_orderkey AS run_id, l_linenumber AS fill, l_partkey, CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) AS price, CAST(l_quantity AS BIGINT) AS qty,
         CASE WHEN l_returnflag = 'N' THEN 'MAKER' ELSE 'TAKER' END AS liquidity,
         CAST(floor(l_extendedprice * (l_tax - l_discount / 10) * 1e6 + 0.5) AS BIGINT) AS fee_micro, epoch_us(l_shipdate) * 1000 AS t,
         o_custkey % 10 AS symbol, o_custkey % 5 AS seed, o_orderpriority AS policy, CASE WHEN o_orderstatus IN ('F', 'P') THEN 'BUY' ELSE 'SELL' END AS side,
         epoch_us(o_orderdate) * 1000 AS start, CASE WHEN o_orderkey % 3 = 0 THEN 'EXACT' ELSE 'APPROXIMATE' END AS queue_mode,
         CASE WHEN o_custkey % 2 = 0 THEN 'CONSTANT' ELSE 'OBSERVED' END AS latency_basis, 'NO_IMPACT' AS counterfactual_mode,
         substr(sha256('{"policy": "' || o_orderpriority || '", "queue_mode": "' || CASE WHEN o_orderkey % 3 = 0 THEN 'EXACT' ELSE 'APPROXIMATE' END || '"}'), 1, 16) AS config_fingerprint
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def market_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per symbol and calendar day (as many as there are of both, not of prints): the day's prints and
    quote (least and greatest price), running sums up to the day, and the last and next quoted day."""
    prints = read(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("symbol"),
        F.floor(nanos("l_shipdate") / F.lit(DAY)).cast("long").alias("day"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5).cast("long").alias("price"),
        F.col("l_quantity").cast("long").alias("qty"),
    )
    notional = (F.col("price") * F.col("qty")).cast("decimal(38,0)")
    daily = prints.groupBy("symbol", "day").agg(F.count("*").alias("n"), F.sum("qty").alias("q"), F.sum(notional).alias("v"), (F.min("price") + F.max("price")).alias("mid2"))
    ends = daily.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    grid = daily.select("symbol").distinct().crossJoin(F.broadcast(ends)).select("symbol", F.explode(F.sequence("a", "b")).alias("day"))  # ends: one row
    w = Window.partitionBy("symbol").orderBy("day")
    upto, before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    quoted = F.col("mid2").isNotNull()
    d = grid.join(daily, ["symbol", "day"], "left").withColumn("prior", F.last(F.when(quoted, F.struct("day", "mid2")), ignorenulls=True).over(before))
    area = F.when(quoted, (F.col("mid2") + F.col("prior.mid2")) * (F.col("day") - F.col("prior.day")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    d = d.withColumns({"area": zero(F.sum(area).over(upto)), "mids": F.count("mid2").over(upto), "total": zero(F.sum("mid2").over(upto)), "prints": zero(F.sum("n").over(upto)), "volume": zero(F.sum("q").over(upto)), "notional": zero(F.sum("v").over(upto))})
    at = F.when(quoted, F.struct("day", "mid2", "area", "mids", "total"))
    return d.select(
        "symbol",
        "day",
        "prior",
        F.last(at, ignorenulls=True).over(upto).alias("last"),
        F.first(at, ignorenulls=True).over(after).alias("next"),
        "prints",
        "volume",
        "notional",
        (F.col("prints") - zero(F.col("n"))).alias("prints_before"),
        (F.col("volume") - zero(F.col("q"))).alias("volume_before"),
        (F.col("notional") - zero(F.col("v"))).alias("notional_before"),
    )


MARKET = f"""md AS (SELECT l_suppkey % 10 AS symbol, epoch_us(l_shipdate) * 1000 // {DAY} AS day, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q,
    sum(floor(l_extendedprice / l_quantity * 100 + 0.5)::BIGINT * l_quantity::BIGINT) AS v, min(floor(l_extendedprice / l_quantity * 100 + 0.5)::BIGINT) + max(floor(l_extendedprice / l_quantity * 100 + 0.5)::BIGINT) AS mid2
  FROM lineitem GROUP BY ALL)"""


def _in_market(frame: DataFrame, days: DataFrame, day, name: str) -> DataFrame:
    """``frame`` with the market's row of a day, as a struct."""
    row = days.select(F.col("symbol").alias("__symbol"), F.col("day").alias("__day"), F.struct(*days.columns).alias(name))
    return frame.withColumn("__at", day).join(row, (F.col("symbol") == F.col("__symbol")) & (F.col("__at") == F.col("__day")), "left").drop("__at", "__day", "__symbol")


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run with fills: what it asked for and got, and the market's prices in its window
    (the order's day to WINDOW_DAYS later): first, last and mean mid, VWAP, TWAP; null without mids.
    Sums over a window are differences of running sums, so a run costs two lookups."""
    f = fills(spark, sf_dir)
    keys = ["run_id", "symbol", "seed", "policy", "side", "start", "queue_mode", "latency_basis", "counterfactual_mode", "config_fingerprint"]
    x = f.groupBy(*keys).agg(
        F.sum("qty").alias("filled"),
        F.sum(F.col("price") * F.col("qty")).alias("notional"),
        F.sum("fee_micro").alias("fee_micro"),
        F.sum(F.when(F.col("liquidity") == "MAKER", F.col("qty")).otherwise(0)).alias("maker"),
        F.max("t").alias("last_fill"),
        F.count("*").alias("n_fills"),
    )
    x = x.withColumns({"requested": F.col("filled") + F.col("run_id") % 7, "average": F.col("notional") / F.col("filled"), "day": F.floor(F.col("start") / F.lit(DAY)).cast("long")})
    days = market_days(spark, sf_dir)
    ends = F.broadcast(days.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day")))  # one row
    x = _in_market(x.crossJoin(ends), days, F.greatest(F.col("day"), "first_day"), "a")
    x = _in_market(x, days, F.least(F.col("day") + WINDOW_DAYS, "last_day"), "b")
    inside = F.col("a.next.day") <= F.col("b.last.day")
    width = F.col("b.last.day") - F.col("a.next.day")
    volume = F.col("b.volume") - F.col("a.volume_before")
    return x.select(
        *keys,
        "filled",
        "notional",
        "fee_micro",
        "maker",
        "n_fills",
        "requested",
        "average",
        (F.col("last_fill") - F.col("start")).alias("duration"),
        F.when(inside, F.col("a.next.mid2")).alias("arrival2"),
        F.when(inside, F.col("b.last.mid2")).alias("terminal2"),
        F.coalesce(F.when(inside, F.col("b.last.mids") - F.col("a.next.mids") + 1), F.lit(0)).alias("n_mids"),
        F.coalesce(F.col("b.prints") - F.col("a.prints_before"), F.lit(0)).alias("n_prints"),
        F.coalesce(volume, F.lit(0)).alias("market_volume"),
        F.when(volume > 0, (F.col("b.notional") - F.col("a.notional_before")).cast("double") / volume).alias("vwap"),
        F.when(inside & (width > 0), (F.col("b.last.area") - F.col("a.next.area")) / (width * 4)).alias("twap"),
    )


EXECUTIONS = (
    FILLS
    + ", "
    + MARKET
    + f""",
x0 AS (
  SELECT run_id, symbol, seed, policy, side, start, queue_mode, latency_basis, counterfactual_mode, config_fingerprint, CAST(sum(qty) AS BIGINT) AS filled, CAST(sum(price * qty) AS BIGINT) AS notional,
         CAST(sum(fee_micro) AS BIGINT) AS fee_micro, CAST(sum(CASE WHEN liquidity = 'MAKER' THEN qty ELSE 0 END) AS BIGINT) AS maker, max(t) - min(start) AS duration, count(*) AS n_fills
  FROM fl GROUP BY ALL),
wd AS (SELECT run_id, md.*, lead(mid2) OVER w AS mid2_b, lead(md.day) OVER w AS day_b FROM x0 JOIN md ON md.symbol = x0.symbol AND md.day BETWEEN start // {DAY} AND start // {DAY} + {WINDOW_DAYS} WINDOW w AS (PARTITION BY run_id ORDER BY md.day)),
wi AS (SELECT run_id, arg_min(mid2, day) AS arrival2, arg_max(mid2, day) AS terminal2, count(*) AS n_mids, CAST(sum(n) AS BIGINT) AS n_prints, CAST(sum(q) AS BIGINT) AS market_volume, sum(v)::DOUBLE / sum(q)::DOUBLE AS vwap,
  CASE WHEN max(day) > min(day) THEN sum((mid2 + mid2_b) * (day_b - day))::DOUBLE / ((max(day) - min(day)) * 4)::DOUBLE END AS twap FROM wd GROUP BY run_id),
ex AS (SELECT x0.*, filled + run_id % 7 AS requested, notional::DOUBLE / filled AS average, CASE WHEN side = 'BUY' THEN 1 ELSE -1 END AS sg, arrival2, terminal2, coalesce(n_mids, 0) AS n_mids, coalesce(n_prints, 0) AS n_prints,
  coalesce(market_volume, 0) AS market_volume, vwap, twap FROM x0 LEFT JOIN wi USING (run_id))"""
)


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions with cost columns in millionths of a bps: of the filled part against each price,
    fees on the requested and on the filled quantity, and the shortfall of all that was asked for."""
    x = executions(spark, sf_dir)
    side, average = F.col("side"), F.col("average")
    arrival, terminal = F.col("arrival2") / 2, F.col("terminal2") / 2
    fill_ratio = F.col("filled") / F.col("requested")
    fee = F.col("fee_micro") / F.lit(1e4)  # ticks of a hundredth
    x = x.select(
        "*",
        tca.micro(tca.signed_cost_bps(average, arrival, side)).alias("vs_arrival"),
        tca.micro(tca.signed_cost_bps(average, F.col("vwap"), side)).alias("vs_vwap"),
        tca.micro(tca.signed_cost_bps(average, F.col("twap"), side)).alias("vs_twap"),
        tca.micro(tca.signed_cost_bps(average, terminal, side)).alias("vs_terminal"),
        tca.micro(tca.signed_cost_bps(terminal, arrival, side)).alias("opportunity"),
        tca.micro(tca.shortfall_bps(average, arrival, terminal, fill_ratio, side)).alias("price_shortfall"),
        tca.micro(tca.fees_bps(fee, arrival, F.col("requested"))).alias("fees_requested"),
        tca.micro(tca.fees_bps(fee, arrival, F.col("filled"))).alias("fees"),
        tca.micro(tca.ratio(F.col("filled"), F.col("requested"))).alias("completion"),
        tca.micro(tca.ratio(F.col("maker"), F.col("filled"))).alias("maker_ratio"),
        tca.micro(tca.ratio(F.col("filled"), F.col("market_volume"))).alias("participation"),
    )
    return x.withColumn("shortfall", F.col("price_shortfall") + F.col("fees_requested"))


def _bps(price: str, bench: str) -> str:
    return f"CASE WHEN {bench} > 0 THEN CAST(floor(({price} - {bench}) / {bench} * 1e4 * sg * 1e6 + 0.5) AS BIGINT) END"


COSTS = (
    EXECUTIONS
    + f""",
c0 AS (SELECT *, arrival2::DOUBLE / 2 AS arrival, terminal2::DOUBLE / 2 AS terminal FROM ex),
c1 AS (
  SELECT *, {_bps('average', 'arrival')} AS vs_arrival, {_bps('average', 'vwap')} AS vs_vwap, {_bps('average', 'twap')} AS vs_twap, {_bps('average', 'terminal')} AS vs_terminal, {_bps('terminal', 'arrival')} AS opportunity,
    CASE WHEN arrival > 0 THEN CAST(floor((CASE WHEN filled > 0 THEN (average - arrival) / arrival * 1e4 * sg * (filled::DOUBLE / requested) ELSE 0 END
       + CASE WHEN filled < requested THEN (terminal - arrival) / arrival * 1e4 * sg * (1.0::DOUBLE - filled::DOUBLE / requested) ELSE 0 END) * 1e6 + 0.5) AS BIGINT) END AS price_shortfall,
    CASE WHEN arrival > 0 THEN CAST(floor(fee_micro / 1e4::DOUBLE * 1e4::DOUBLE / (arrival * requested) * 1e6 + 0.5) AS BIGINT) END AS fees_requested,
    CASE WHEN arrival > 0 THEN CAST(floor(fee_micro / 1e4::DOUBLE * 1e4::DOUBLE / (arrival * filled) * 1e6 + 0.5) AS BIGINT) END AS fees,
    CAST(floor(filled::DOUBLE / requested * 1e6 + 0.5) AS BIGINT) AS completion, CAST(floor(maker::DOUBLE / filled * 1e6 + 0.5) AS BIGINT) AS maker_ratio,
    CASE WHEN market_volume > 0 THEN CAST(floor(filled::DOUBLE / market_volume * 1e6 + 0.5) AS BIGINT) ELSE 0 END AS participation
  FROM c0),
co AS (SELECT *, price_shortfall + fees_requested AS shortfall FROM c1)"""
)


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs with what they are made of: spread and timing (weighted by quantity over the fills that
    have a quoted day in the window before their own), fees on the filled quantity, the rest."""
    f = _in_market(fills(spark, sf_dir), market_days(spark, sf_dir), F.floor(F.col("t") / F.lit(DAY)).cast("long"), "m")
    prior = F.when(F.col("m.prior.day") >= F.floor(F.col("start") / F.lit(DAY)), F.col("m.prior.mid2") / 2)
    f = f.select("run_id", "qty", prior.alias("mid"), tca.micro(tca.signed_cost_bps(F.col("price"), prior, F.col("side"))).alias("spread"))
    of = f.groupBy("run_id").agg(
        F.sum(F.col("spread") * F.col("qty")).alias("spread_q"),
        F.sum(F.when(F.col("spread").isNotNull(), F.col("qty"))).alias("spread_n"),
        F.sum(F.col("mid") * 2 * F.col("qty")).cast("long").alias("mid2_q"),
        F.sum(F.when(F.col("mid").isNotNull(), F.col("qty"))).alias("mid_n"),
        F.sum(F.when(F.col("mid").isNull(), 1).otherwise(0)).alias("n_without_mid"),
    )
    x = costs(spark, sf_dir).join(of, "run_id")
    spread = F.floor(F.col("spread_q") / F.col("spread_n") + 0.5).cast("long")
    timing = tca.micro(tca.signed_cost_bps(F.col("mid2_q") / F.col("mid_n") / 2, F.col("arrival2") / 2, F.col("side")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    x = x.withColumns({"spread_cost": spread, "timing": timing}).drop("spread_q", "spread_n", "mid2_q", "mid_n")
    explained = F.when(F.col("spread_cost").isNotNull() | F.col("timing").isNotNull(), zero(F.col("spread_cost")) + zero(F.col("fees")) + zero(F.col("timing")))
    is_filled = F.col("vs_arrival") + zero(F.col("fees"))
    return x.withColumns({"explained": explained, "is_filled": is_filled, "residual": is_filled - explained})


ATTRIBUTION = (
    COSTS
    + f""",
pm AS (SELECT fl.*, CASE WHEN side = 'BUY' THEN 1 ELSE -1 END AS sg, (SELECT arg_max(md.mid2, md.day) FROM md WHERE md.symbol = fl.symbol AND md.day >= fl.start // {DAY} AND md.day < fl.t // {DAY})::DOUBLE / 2 AS mid FROM fl),
ps AS (SELECT *, {_bps('price', 'mid')} AS spread FROM pm),
pa AS (SELECT run_id, CAST(floor(sum(spread * qty)::DOUBLE / sum(CASE WHEN spread IS NOT NULL THEN qty END)::DOUBLE + 0.5) AS BIGINT) AS spread_cost,
  sum(mid * 2 * qty)::DOUBLE / sum(CASE WHEN mid IS NOT NULL THEN qty END)::DOUBLE / 2 AS mean_mid, CAST(sum(CASE WHEN mid IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_without_mid FROM ps GROUP BY run_id),
a0 AS (SELECT co.*, spread_cost, n_without_mid, {_bps('mean_mid', 'arrival')} AS timing FROM co JOIN pa USING (run_id)),
ab AS (SELECT *, vs_arrival + coalesce(fees, 0) AS is_filled, CASE WHEN spread_cost IS NOT NULL OR timing IS NOT NULL THEN coalesce(spread_cost, 0) + coalesce(fees, 0) + coalesce(timing, 0) END AS explained FROM a0),
an AS (SELECT *, is_filled - explained AS residual FROM ab)"""
)


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the best bid and ask and their sizes as known after each event."""
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    values = {"bid": of("BID", "price"), "bid_qty": of("BID", "qty"), "ask": of("ASK", "price"), "ask_qty": of("ASK", "qty")}
    q = windows.known(events(spark, sf_dir), ["symbol"], ["t", "seq"], values)
    return q.withColumn("mid2", F.col("bid") + F.col("ask"))


QUOTES = (
    EVENTS
    + """,
qu AS (
  SELECT *, bid + ask AS mid2 FROM (
    SELECT *, last_value(CASE WHEN kind = 'BID' THEN price END IGNORE NULLS) OVER w AS bid, last_value(CASE WHEN kind = 'BID' THEN qty END IGNORE NULLS) OVER w AS bid_qty,
      last_value(CASE WHEN kind = 'ASK' THEN price END IGNORE NULLS) OVER w AS ask, last_value(CASE WHEN kind = 'ASK' THEN qty END IGNORE NULLS) OVER w AS ask_qty
    FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"""
)
