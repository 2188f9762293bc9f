"""Books, matching, schedules, profiles, fees and validation."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.functions.tca import micro
from tapeworks.operators import asof, matching, windows
from tapeworks.sources import market as M

#: Price levels are bands of this many ticks, so that levels hold several events.
BAND = 5000
DAY = 86_400_000_000_000


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed changes of level sizes: quotes and ADD add; CANCEL takes from its own side, TRADE from
    the resting one, opposite to the side that took. Levels count from 1."""
    e = M.events(spark, sf_dir)
    level = (F.floor(F.col("price") / BAND) + 1).cast("long")
    buys = F.when(F.col("kind") == "TRADE", F.col("side") == "SELL").otherwise(F.col("side") == "BUY")
    book = F.when(F.col("kind").isin("BID", "ASK"), F.col("kind")).when(buys, "BID").otherwise("ASK")
    change = F.when(F.col("kind").isin("CANCEL", "TRADE"), -F.col("qty")).otherwise(F.col("qty"))
    return e.select("symbol", "seq", "t", "kind", book.alias("book"), level.alias("level"), change.alias("change"))


DELTAS = f"""{M.EVENTS}, de AS (
  SELECT symbol, seq, t, kind, CASE WHEN kind IN ('BID', 'ASK') THEN kind WHEN (side = 'BUY') <> (kind = 'TRADE') THEN 'BID' ELSE 'ASK' END AS book, CAST(floor(price / {BAND}) AS BIGINT) + 1 AS level,
    CASE WHEN kind IN ('CANCEL', 'TRADE') THEN -qty ELSE qty END AS change FROM ev)"""

_LEVEL = ["symbol", "book", "level"]


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of its level after each event and before it. What would take more than is there takes
    what there is, so a size is the running sum less the least it has been below zero."""
    d = windows.cumulative(_deltas(spark, sf_dir), _LEVEL, ["t", "seq"], {"total": F.col("change")})
    d = windows.highest_before(d, _LEVEL, ["t", "seq"], {"short": -F.col("total")})
    after = F.col("total") + F.greatest(F.lit(0), F.coalesce("short", F.lit(0)), -F.col("total"))
    before = F.col("total") - F.col("change") + F.greatest(F.lit(0), F.coalesce("short", F.lit(0)))
    return d.withColumns({"size": after, "before": before}).drop("total", "short")


SIZES = f"""{DELTAS}, ru AS (SELECT *, sum(change) OVER (PARTITION BY symbol, book, level ORDER BY t, seq) AS total FROM de),
si AS (SELECT * EXCLUDE (total), CAST(total - least(0, min(total) OVER w) AS BIGINT) AS size,
  CAST(total - change - least(0, coalesce(min(total) OVER (PARTITION BY symbol, book, level ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) AS before
  FROM ru WINDOW w AS (PARTITION BY symbol, book, level ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def level_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir).select("symbol", "seq", "book", "level", "size")


LEVEL_SIZE = f"WITH {SIZES} SELECT symbol, seq, book, level, size FROM si"


def _final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir).groupBy(*_LEVEL).agg(F.max_by("size", F.struct("t", "seq")).alias("size")).where("size > 0")


FINAL = f"{SIZES}, fi AS (SELECT symbol, book, level, arg_max(size, (t, seq)) AS size FROM si GROUP BY symbol, book, level HAVING arg_max(size, (t, seq)) > 0)"


def best_bid_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    bid, ask = F.col("book") == "BID", F.col("book") == "ASK"
    return _final(spark, sf_dir).groupBy("symbol").agg(
        F.max(F.when(bid, F.col("level"))).alias("bid"),
        F.min(F.when(ask, F.col("level"))).alias("ask"),
        F.max_by(F.when(bid, F.col("size")), F.when(bid, F.col("level"))).alias("bid_size"),
        F.min_by(F.when(ask, F.col("size")), F.when(ask, F.col("level"))).alias("ask_size"),
        F.sum(F.when(bid, F.col("size"))).alias("bid_depth"),
        F.sum(F.when(ask, F.col("size"))).alias("ask_depth"),
    )


BEST = f"""WITH {FINAL} SELECT symbol, max(CASE WHEN book = 'BID' THEN level END) AS bid, min(CASE WHEN book = 'ASK' THEN level END) AS ask,
  arg_max(size, level) FILTER (book = 'BID') AS bid_size, arg_min(size, level) FILTER (book = 'ASK') AS ask_size,
  CAST(sum(size) FILTER (book = 'BID') AS BIGINT) AS bid_depth, CAST(sum(size) FILTER (book = 'ASK') AS BIGINT) AS ask_depth FROM fi GROUP BY symbol"""


def _best_first():
    return F.when(F.col("book") == "BID", -F.col("level")).otherwise(F.col("level"))


def topn_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("symbol", "book").orderBy(_best_first())
    ranked = _final(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    return ranked.select("symbol", "book", "rank", "level", "size", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))


TOPN = f"""WITH {FINAL}, r AS (SELECT *, row_number() OVER w AS rank, CAST(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative FROM fi
  WINDOW w AS (PARTITION BY symbol, book ORDER BY CASE WHEN book = 'BID' THEN -level ELSE level END))
SELECT symbol, book, rank::INTEGER AS rank, level, size, cumulative FROM r WHERE rank <= 5"""


def depth_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares slope of cumulative size on distance from the touch; null under two levels."""
    w = Window.partitionBy("symbol", "book").orderBy(_best_first()).rowsBetween(Window.unboundedPreceding, 0)
    x = _final(spark, sf_dir).withColumns({"y": F.sum("size").over(w), "x": F.abs(F.col("level") - F.first("level").over(w))})
    n, sx, sy, sxy, sxx = F.count("*"), F.sum("x"), F.sum("y"), F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x"))
    slope = F.when(n < 2, None).when(n * sxx - sx * sx == 0, F.lit(0).cast("long")).otherwise(micro((n * sxy - sx * sy) / (n * sxx - sx * sx)))
    return x.groupBy("symbol", "book").agg(n.alias("levels"), slope.alias("slope"))


SLOPE = f"""WITH {FINAL}, c AS (SELECT *, sum(size) OVER w AS y, abs(level - first_value(level) OVER w) AS x FROM fi
  WINDOW w AS (PARTITION BY symbol, book ORDER BY CASE WHEN book = 'BID' THEN -level ELSE level END ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT symbol, book, count(*) AS levels, CASE WHEN count(*) < 2 THEN NULL WHEN count(*) * sum(x * x) - sum(x) * sum(x) = 0 THEN 0
  ELSE CAST(floor((count(*) * sum(x * y) - sum(x) * sum(y))::DOUBLE / (count(*) * sum(x * x) - sum(x) * sum(x))::DOUBLE * 1e6 + 0.5) AS BIGINT) END AS slope FROM c GROUP BY symbol, book"""


def sweep_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market orders of three sizes walk each side of the final books."""
    orders = F.explode(F.array(*[F.lit(q).cast("long") for q in (50, 500, 100000)])).alias("quantity")
    levels = _final(spark, sf_dir).select("*", orders)
    taken = matching.sweep(levels, ["symbol", "book", "quantity"], [_best_first()], "size", "quantity").where("take > 0")
    return taken.groupBy("symbol", "book", "quantity").agg(
        F.sum("take").alias("filled"), F.count("*").alias("levels"), micro(F.sum(F.col("take") * F.col("level")) / F.sum("take")).alias("average"), F.max_by("level", F.when(F.col("book") == "BID", -F.col("level")).otherwise(F.col("level"))).alias("worst")
    )


SWEEP = f"""WITH {FINAL}, q AS (SELECT fi.*, unnest([50, 500, 100000])::BIGINT AS quantity FROM fi),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY symbol, book, quantity ORDER BY CASE WHEN book = 'BID' THEN -level ELSE level END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q),
k AS (SELECT *, greatest(0, least(size, quantity - before)) AS take FROM b)
SELECT symbol, book, quantity, CAST(sum(take) AS BIGINT) AS filled, count(*) AS levels, CAST(floor(sum(take * level)::DOUBLE / sum(take)::DOUBLE * 1e6 + 0.5) AS BIGINT) AS average,
  arg_max(level, CASE WHEN book = 'BID' THEN -level ELSE level END) AS worst FROM k WHERE take > 0 GROUP BY ALL"""


def scenario_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book's asks under a grid of order sizes and fees: executed cost against the touch."""
    asks = F.array_sort(F.collect_list(F.struct(F.col("level").alias("price"), "size")))
    books = _final(spark, sf_dir).where("book = 'ASK'").groupBy("symbol").agg(asks.alias("asks"))  # one array a book: as many levels as it has
    grid = books.select("*", F.explode(F.array(*[F.lit(q).cast("long") for q in (100, 1000, 5000)])).alias("quantity"))
    grid = grid.select("*", F.explode(F.array(*[F.lit(b) for b in (0, 5, 10)])).alias("fee_bps"))
    r = grid.withColumn("r", matching.fold_sweep(F.col("asks"), F.col("quantity")))
    touch = F.col("asks")[0]["price"]
    cost = (F.col("r.notional") / F.col("r.filled") - touch) / touch * 1e4 + F.col("fee_bps")
    return r.select("symbol", "quantity", "fee_bps", F.col("r.filled").alias("filled"), F.col("r.n").alias("levels"), F.col("r.worst").alias("worst"), micro(cost).alias("cost_bps"))


GRID = f"""WITH {FINAL}, q AS (SELECT symbol, level, size, quantity FROM fi, (SELECT unnest([100, 1000, 5000])::BIGINT AS quantity) WHERE book = 'ASK'),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY symbol, quantity ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, min(level) OVER (PARTITION BY symbol) AS touch FROM q),
k AS (SELECT symbol, quantity, touch, CAST(sum(least(size, quantity - before)) AS BIGINT) AS filled, count(*) AS levels, max(level) AS worst, CAST(sum(least(size, quantity - before) * level) AS BIGINT) AS notional
  FROM b WHERE before < quantity GROUP BY ALL)
SELECT symbol, quantity, fee_bps, filled, levels::INTEGER AS levels, worst, CAST(floor(((notional::DOUBLE / filled - touch) / touch * 1e4 + fee_bps) * 1e6 + 0.5) AS BIGINT) AS cost_bps
FROM k, (SELECT unnest([0, 5, 10])::INTEGER AS fee_bps)"""

BUCKETS = 24


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traded quantity by symbol, day and bucket of the day."""
    e = M.events(spark, sf_dir).where("kind = 'TRADE'")
    day = F.floor(F.col("t") / DAY)
    bucket = F.least(F.floor((F.col("t") % DAY) * BUCKETS / DAY), F.lit(BUCKETS - 1)).cast("long")
    return e.groupBy("symbol", day.alias("day"), bucket.alias("bucket")).agg(F.sum("qty").alias("volume"))


PROFILE = f"{M.EVENTS}, pr AS (SELECT symbol, t // {DAY} AS day, CAST(least(floor((t % {DAY})::DOUBLE * {BUCKETS} / {DAY}), {BUCKETS - 1}) AS BIGINT) AS bucket, CAST(sum(qty) AS BIGINT) AS volume FROM ev WHERE kind = 'TRADE' GROUP BY ALL)"


def profile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over days of each day's share of a bucket, in parts of 1e9."""
    p = _profile(spark, sf_dir)
    total = F.sum("volume").over(Window.partitionBy("symbol", "day"))
    days = p.groupBy("symbol").agg(F.countDistinct("day").alias("days"))
    share = p.select("symbol", "bucket", F.floor(F.col("volume") / total * 1e9 + 0.5).cast("long").alias("share"))
    return share.groupBy("symbol", "bucket").agg(F.sum("share").alias("s")).join(days, "symbol").select("symbol", "bucket", F.floor(F.col("s") / F.col("days") + 0.5).cast("long").alias("weight"))


MERGE = f"""WITH {PROFILE}, s AS (SELECT symbol, bucket, CAST(floor(volume::DOUBLE / sum(volume) OVER (PARTITION BY symbol, day)::DOUBLE * 1e9 + 0.5) AS BIGINT) AS share FROM pr),
d AS (SELECT symbol, count(DISTINCT day) AS days FROM pr GROUP BY symbol)
SELECT symbol, bucket, CAST(floor(sum(share)::DOUBLE / any_value(days) + 0.5) AS BIGINT) AS weight FROM s JOIN d USING (symbol) GROUP BY symbol, bucket"""


def profile_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 buckets onto 10 slices by overlap, in parts of 120ths of a bucket."""
    p = _profile(spark, sf_dir).groupBy("symbol", "bucket").agg(F.sum("volume").alias("volume"))
    cut = p.select("*", F.explode(F.sequence(F.floor(F.col("bucket") * 10 / 24), F.least(F.lit(9), F.floor((F.col("bucket") + 1) * 10 / 24)))).alias("slice"))
    overlap = F.least((F.col("bucket") + 1) * 10, (F.col("slice") + 1) * 24) - F.greatest(F.col("bucket") * 10, F.col("slice") * 24)
    return cut.withColumn("o", overlap).where("o > 0").groupBy("symbol", "slice").agg(F.sum(F.col("o") * F.col("volume")).alias("weight"))


RESAMPLE = f"""WITH {PROFILE}, p AS (SELECT symbol, bucket, sum(volume) AS volume FROM pr GROUP BY ALL), s AS (SELECT unnest(range(10)) AS slice)
SELECT symbol, slice, CAST(sum((least((bucket + 1) * 10, (slice + 1) * 24) - greatest(bucket * 10, slice * 24)) * volume) AS BIGINT) AS weight
FROM p JOIN s ON least((bucket + 1) * 10, (slice + 1) * 24) > greatest(bucket * 10, slice * 24) GROUP BY ALL"""


def _schedule(spark: SparkSession, sf_dir: str, weight) -> DataFrame:
    """Cumulative targets of 30 slices: rounded half even, the last the whole."""
    x = M.executions(spark, sf_dir).select("run_id", "requested", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("slice"))
    target = F.when(F.col("slice") == 30, F.col("requested")).otherwise(F.rint(F.col("requested") * weight(F.col("slice"))).cast("long"))
    return x.select("run_id", "slice", target.alias("target"))


def twap_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _schedule(spark, sf_dir, lambda s: s / F.lit(30.0))


KAPPA = math.sqrt(0.5 * 1e-3 / 1.0)


def ac_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executed share after a slice under hyperbolic decay of what is left."""
    return _schedule(spark, sf_dir, lambda s: F.lit(1.0) - F.sinh(F.lit(KAPPA) * (F.lit(30.0) - s)) / F.sinh(F.lit(KAPPA * 30.0)))


def _schedule_sql(weight: str) -> str:
    return f"""WITH {M.EXECUTIONS}, s AS (SELECT unnest(range(1, 31)) AS slice)
SELECT run_id, slice::INTEGER AS slice, CASE WHEN slice = 30 THEN requested ELSE CAST(round_even(requested * ({weight}), 0) AS BIGINT) END AS target FROM ex, s"""


def fee_incremental_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commission of 3 a unit, 100 at least per run, charged fill by fill as it grows."""
    f = M.fills(spark, sf_dir)
    w = Window.partitionBy("run_id").orderBy("t", "price", "qty", "fee_micro", "l_partkey").rowsBetween(Window.unboundedPreceding, 0)
    after = F.greatest(F.sum("qty").over(w) * 3, F.lit(100))
    before = F.when(F.sum("qty").over(w) == F.col("qty"), F.lit(0)).otherwise(F.greatest((F.sum("qty").over(w) - F.col("qty")) * 3, F.lit(100)))
    charged = f.withColumn("commission", after - before)
    return charged.groupBy("run_id").agg(F.sum("commission").alias("commission"), F.max("commission").alias("largest"), F.count("*").alias("n_fills"))


FEE = f"""WITH {M.FILLS}, c AS (SELECT *, sum(qty) OVER (PARTITION BY run_id ORDER BY t, price, qty, fee_micro, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM fl),
d AS (SELECT *, greatest(upto * 3, 100) - CASE WHEN upto = qty THEN 0 ELSE greatest((upto - qty) * 3, 100) END AS commission FROM c)
SELECT run_id, CAST(sum(commission) AS BIGINT) AS commission, CAST(max(commission) AS BIGINT) AS largest, count(*) AS n_fills FROM d GROUP BY run_id"""


def _queue(policy: str):
    """An order of 100 joins the back of each level after its tenth event: ahead of it is the size
    then. Later trades at the level work off what is ahead and then reach it; a cancel works off
    nothing (optimistic) or all that it takes (conservative), but never reaches it."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = windows.numbered(_sizes(spark, sf_dir), _LEVEL, ["t", "seq"])
        joined = d.where("k = 9").select(*_LEVEL, F.col("size").alias("joined"))
        d = d.where("k > 9").join(joined, _LEVEL)
        trade = F.when(F.col("kind") == "TRADE", -F.col("change")).otherwise(0)
        cancel = F.when(F.col("kind") == "CANCEL", F.col("before") - F.col("size")).otherwise(0)
        works = trade + (cancel if policy == "conservative" else F.lit(0))
        d = windows.cumulative(d.withColumns({"trade": trade, "works": works}), _LEVEL, ["t", "seq"], {"worked": F.col("works")})
        ahead_before = F.greatest(F.lit(0), F.col("joined") - (F.col("worked") - F.col("works")))
        d = d.withColumns({"reaches": F.greatest(F.lit(0), F.col("trade") - ahead_before), "ahead": F.greatest(F.lit(0), F.col("joined") - F.col("worked"))})
        return d.groupBy(*_LEVEL).agg(F.first("joined").alias("joined"), F.min("ahead").alias("ahead"), F.least(F.lit(100), F.sum("reaches")).alias("filled"))

    cancel = "WHEN kind = 'CANCEL' THEN before - size" if policy == "conservative" else ""
    sql = f"""WITH {SIZES}, nu AS (SELECT *, row_number() OVER (PARTITION BY symbol, book, level ORDER BY t, seq) - 1 AS k FROM si),
jo AS (SELECT symbol, book, level, size AS joined FROM nu WHERE k = 9),
la AS (SELECT nu.*, joined, CASE WHEN kind = 'TRADE' THEN -change ELSE 0 END AS trade, CASE WHEN kind = 'TRADE' THEN -change {cancel} ELSE 0 END AS works FROM nu JOIN jo USING (symbol, book, level) WHERE k > 9),
wo AS (SELECT *, sum(works) OVER (PARTITION BY symbol, book, level ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS worked FROM la)
SELECT symbol, book, level, any_value(joined) AS joined, CAST(min(greatest(0, joined - worked)) AS BIGINT) AS ahead, CAST(least(100, sum(greatest(0, trade - greatest(0, joined - (worked - works))))) AS BIGINT) AS filled
FROM wo GROUP BY symbol, book, level"""
    return query, sql


LATENCIES, FEES_BPS, SLICES, TO_BUY = (0, 3_600_000_000_000, 21_600_000_000_000), (0, 5, 10), 10, 1003


def depth_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buying at once or in ten slices under a grid of latencies and fees, against the asks as they
    stood when each child arrived: price against the ask touch at the start, and with fees."""
    sizes = _sizes(spark, sf_dir).where("book = 'ASK'").select("symbol", "level", "t", "seq", "size")
    bounds = M.events(spark, sf_dir).groupBy("symbol").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    begin = (F.col("a") + F.floor((F.col("b") - F.col("a")) / 4)).cast("long")
    step = F.floor((F.col("b") - F.col("a")) / 40).cast("long")
    base, rest = divmod(TO_BUY, SLICES)
    at_once = F.array(F.struct(F.lit("immediate").alias("style"), F.lit(0).cast("long").alias("slice"), F.lit(TO_BUY).cast("long").alias("quantity")))
    sliced = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SLICES - 1).cast("long")), lambda k: F.struct(F.lit("sliced").alias("style"), k.alias("slice"), (F.lit(base) + F.when(k < rest, 1).otherwise(0)).cast("long").alias("quantity")))
    children = bounds.select("symbol", begin.alias("begin"), step.alias("step"), F.explode(F.concat(at_once, sliced)).alias("c")).select("symbol", "begin", "step", "c.*")
    children = children.select("*", F.explode(F.array(*[F.lit(x).cast("long") for x in LATENCIES])).alias("latency"))
    children = children.withColumn("at", F.col("begin") + F.col("slice") * F.col("step") + F.col("latency"))
    levels = sizes.select("symbol", "level").distinct()
    probes = children.unionByName(children.select("symbol", "begin", "step", F.lit("touch").alias("style"), F.lit(0).cast("long").alias("slice"), F.lit(0).cast("long").alias("quantity"), F.lit(0).cast("long").alias("latency"), F.col("begin").alias("at")).distinct())
    book = asof.asof_join(probes.join(levels, "symbol"), sizes, ["symbol", "level"], "at", "t", "seq", ["size"]).where("size > 0")
    touch = book.where("style = 'touch'").groupBy("symbol").agg(F.min("level").alias("touch"))
    taken = matching.sweep(book.where("style <> 'touch'"), ["symbol", "style", "slice", "latency"], [F.col("level")], "size", "quantity").where("take > 0")
    per = taken.groupBy("symbol", "style", "latency").agg(F.sum("take").alias("filled"), F.sum(F.col("take") * F.col("level")).alias("notional"), F.max("level").alias("worst"), F.countDistinct("slice").alias("n_children"))
    price = (F.col("notional") / F.col("filled") - F.col("touch")) / F.col("touch") * 1e4
    per = per.join(touch, "symbol").select("*", F.explode(F.array(*[F.lit(f) for f in FEES_BPS])).alias("fee_bps"))
    cost = price + F.col("fee_bps") * (F.col("notional") / F.col("filled")) / F.col("touch")
    return per.select("symbol", "style", "latency", "fee_bps", "filled", "notional", "worst", "n_children", micro(price).alias("price_bps"), micro(cost).alias("cost_bps"))


SCENARIOS = f"""WITH {SIZES}, bo AS (SELECT symbol, min(t) + (max(t) - min(t)) // 4 AS begin, (max(t) - min(t)) // 40 AS step FROM ev GROUP BY symbol),
ch AS (SELECT symbol, begin, step, 'immediate' AS style, 0 AS slice, {TO_BUY}::BIGINT AS quantity FROM bo
  UNION ALL SELECT symbol, begin, step, 'sliced', k, {TO_BUY} // {SLICES} + CASE WHEN k < {TO_BUY} % {SLICES} THEN 1 ELSE 0 END FROM bo, range({SLICES}) AS r(k)),
cl AS (SELECT ch.*, latency, begin + slice * step + latency AS at FROM ch, (SELECT unnest({list(LATENCIES)}) AS latency)),
lv AS (SELECT DISTINCT symbol, level FROM si WHERE book = 'ASK'),
bk AS (SELECT cl.*, lv.level, (SELECT arg_max(s.size, (s.t, s.seq)) FROM si s WHERE s.book = 'ASK' AND s.symbol = cl.symbol AND s.level = lv.level AND s.t <= cl.at) AS size FROM cl JOIN lv USING (symbol)),
to_ AS (SELECT symbol, min(level) AS touch FROM (SELECT bo.symbol, lv.level, (SELECT arg_max(s.size, (s.t, s.seq)) FROM si s WHERE s.book = 'ASK' AND s.symbol = bo.symbol AND s.level = lv.level AND s.t <= bo.begin) AS size FROM bo JOIN lv USING (symbol)) WHERE size > 0 GROUP BY symbol),
sw AS (SELECT *, greatest(0, least(size, quantity - coalesce(sum(size) OVER (PARTITION BY symbol, style, slice, latency ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM bk WHERE size > 0),
pe AS (SELECT symbol, style, latency, CAST(sum(take) AS BIGINT) AS filled, CAST(sum(take * level) AS BIGINT) AS notional, max(level) AS worst, count(DISTINCT slice) AS n_children FROM sw WHERE take > 0 GROUP BY ALL)
SELECT symbol, style, latency::BIGINT AS latency, fee_bps, filled, notional, worst, n_children, CAST(floor((notional::DOUBLE / filled - touch) / touch * 1e4 * 1e6 + 0.5) AS BIGINT) AS price_bps,
  CAST(floor(((notional::DOUBLE / filled - touch) / touch * 1e4 + fee_bps * (notional::DOUBLE / filled) / touch) * 1e6 + 0.5) AS BIGINT) AS cost_bps
FROM pe JOIN to_ USING (symbol), (SELECT unnest({list(FEES_BPS)})::INTEGER AS fee_bps)"""


def multi_level_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of the best five levels of each side of the final books, and how it leans; null without depth."""
    five = topn_depth(spark, sf_dir).groupBy("symbol").agg(F.sum(F.when(F.col("book") == "BID", F.col("size")).otherwise(0)).alias("bid_depth"), F.sum(F.when(F.col("book") == "ASK", F.col("size")).otherwise(0)).alias("ask_depth"))
    total = F.col("bid_depth") + F.col("ask_depth")
    return five.withColumn("imbalance", F.when(total > 0, micro((F.col("bid_depth") - F.col("ask_depth")) / total)))


def book_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates, trades, traded volume, what was asked for beyond what was there, and locked or crossed times."""
    s = _sizes(spark, sf_dir)
    q = M.quotes(spark, sf_dir).where("mid2 IS NOT NULL").groupBy("symbol").agg(F.sum(F.when(F.col("bid") > F.col("ask"), 1).otherwise(0)).alias("crossed"), F.sum(F.when(F.col("bid") == F.col("ask"), 1).otherwise(0)).alias("locked"))
    trade = F.col("kind") == "TRADE"
    took = F.col("before") - F.col("size")
    per = s.groupBy("symbol").agg(
        F.sum(F.when(~trade, 1).otherwise(0)).alias("updates"),
        F.sum(F.when(trade, 1).otherwise(0)).alias("trades"),
        F.sum(F.when(trade, took).otherwise(0)).alias("traded"),
        F.sum(F.when((F.col("change") < 0) & (took < -F.col("change")), 1).otherwise(0)).alias("violations"),
    )
    return per.join(q, "symbol")


STATS = f"""WITH {SIZES}, {M.QUOTES.removeprefix(M.EVENTS + ',').strip()},
qs AS (SELECT symbol, CAST(sum(CASE WHEN bid > ask THEN 1 ELSE 0 END) AS BIGINT) AS crossed, CAST(sum(CASE WHEN bid = ask THEN 1 ELSE 0 END) AS BIGINT) AS locked FROM qu WHERE mid2 IS NOT NULL GROUP BY symbol),
ss AS (SELECT symbol, CAST(sum(CASE WHEN kind <> 'TRADE' THEN 1 ELSE 0 END) AS BIGINT) AS updates, CAST(sum(CASE WHEN kind = 'TRADE' THEN 1 ELSE 0 END) AS BIGINT) AS trades,
  CAST(sum(CASE WHEN kind = 'TRADE' THEN before - size ELSE 0 END) AS BIGINT) AS traded, CAST(sum(CASE WHEN change < 0 AND before - size < -change THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM si GROUP BY symbol)
SELECT * FROM ss JOIN qs USING (symbol)"""


@dataclass(frozen=True)
class Thresholds:
    """Of the eight regime labels: spreads and depths at the touch, realised volatility in bps, imbalance."""

    tight: int = 1000
    wide: int = 3000
    quiet: int = 2000
    volatile: int = 20000
    deep: int = 120
    thin: int = 40
    leaning: float = 0.5


def regime_labels(states: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """``labels`` of each state with bid, ask, their sizes and vol (bps, null if not known); labels overlap."""
    c = F.col
    depth = c("bid_qty") + c("ask_qty")
    sided = (c("bid_qty") > 0) & (c("ask_qty") > 0)
    leans = F.abs(c("bid_qty") - c("ask_qty")) >= depth * F.lit(limits.leaning)
    rules = {
        "tight": c("ask") - c("bid") <= limits.tight,
        "wide": c("ask") - c("bid") >= limits.wide,
        "volatile": c("vol") >= limits.volatile,
        "quiet": c("vol") <= limits.quiet,
        "deep": depth >= limits.deep,
        "thin": (depth > 0) & (depth <= limits.thin),
        "imbalanced": sided & leans,
        "balanced": sided & ~leans,
    }
    return states.withColumn("labels", F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()])))


def regime_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label how often it holds, for how long before each state, and its share of states and time."""
    from tapeworks.plans import series

    q = windows.previous(M.quotes(spark, sf_dir).where("mid2 IS NOT NULL"), ["symbol"], ["t", "seq"], ["t"])
    vol = series.realized_vol(spark, sf_dir).select("symbol", "seq", (F.col("vol") / 1e6).alias("vol"))
    held = F.coalesce(F.greatest(F.lit(0), F.col("t") - F.col("p_t")), F.lit(0))
    states = regime_labels(q.join(vol, ["symbol", "seq"], "left").withColumn("held", held))
    all_states = states.groupBy("symbol").agg(F.count("*").alias("states"), F.sum("held").alias("time"))
    x = states.select("symbol", "held", F.explode("labels").alias("label")).groupBy("symbol", "label").agg(F.count("*").alias("n"), F.sum("held").alias("held"))
    share = lambda a, b: F.when(F.col(b) > 0, micro(F.col(a) / F.col(b)))
    return x.join(all_states, "symbol").select("symbol", "label", "n", "held", share("n", "states").alias("share_of_states"), share("held", "time").alias("share_of_time"))


def _regimes_sql() -> str:
    from tapeworks.plans import series

    v, d = series.VOL.removeprefix("WITH "), Thresholds()
    head, last = v.rsplit("\nSELECT symbol, seq, CAST(floor(sqrt", 1)
    return f"""WITH {head}, vo AS (SELECT symbol, seq, CAST(floor(sqrt{last}),
x AS (SELECT qu.*, vol / 1e6::DOUBLE AS vol, greatest(0, coalesce(t - lag(t) OVER (PARTITION BY symbol ORDER BY t, seq), 0)) AS held FROM qu LEFT JOIN vo USING (symbol, seq) WHERE mid2 IS NOT NULL),
a AS (SELECT symbol, count(*) AS states, sum(held) AS time FROM x GROUP BY symbol),
l AS (SELECT symbol, held, unnest([CASE WHEN ask - bid <= {d.tight} THEN 'tight' END, CASE WHEN ask - bid >= {d.wide} THEN 'wide' END, CASE WHEN vol >= {d.volatile} THEN 'volatile' END, CASE WHEN vol <= {d.quiet} THEN 'quiet' END,
  CASE WHEN bid_qty + ask_qty >= {d.deep} THEN 'deep' END, CASE WHEN bid_qty + ask_qty <= {d.thin} THEN 'thin' END,
  CASE WHEN abs(bid_qty - ask_qty) * 2 >= bid_qty + ask_qty THEN 'imbalanced' ELSE 'balanced' END]) AS label FROM x),
g AS (SELECT symbol, label, count(*) AS n, CAST(sum(held) AS BIGINT) AS held FROM l WHERE label IS NOT NULL GROUP BY symbol, label)
SELECT symbol, label, n, held, CAST(floor(n::DOUBLE / states * 1e6 + 0.5) AS BIGINT) AS share_of_states, CASE WHEN time > 0 THEN CAST(floor(held::DOUBLE / time::DOUBLE * 1e6 + 0.5) AS BIGINT) END AS share_of_time FROM g JOIN a USING (symbol)"""


QUERIES = {
    "level_size": (level_size, LEVEL_SIZE),
    "best_bid_ask": (best_bid_ask, BEST),
    "topn_depth": (topn_depth, TOPN),
    "depth_slope": (depth_slope, SLOPE),
    "sweep_match": (sweep_match, SWEEP),
    "scenario_grid": (scenario_grid, GRID),
    "volume_profile": (_profile, f"WITH {PROFILE} SELECT * FROM pr"),
    "profile_merge": (profile_merge, MERGE),
    "profile_resample": (profile_resample, RESAMPLE),
    "twap_schedule": (twap_schedule, _schedule_sql("slice / 30.0::DOUBLE")),
    "ac_schedule": (ac_schedule, _schedule_sql(f"1.0::DOUBLE - sinh({KAPPA!r}::DOUBLE * (30.0 - slice)) / sinh({KAPPA * 30.0!r}::DOUBLE)")),
    "fee_incremental_minimum": (fee_incremental_minimum, FEE),
    "queue_optimistic": _queue("optimistic"),
    "queue_conservative": _queue("conservative"),
    "regime_tally": (regime_tally, _regimes_sql()),
    "depth_scenarios": (depth_scenarios, SCENARIOS),
    "multi_level_imbalance": (
        multi_level_imbalance,
        f"""WITH {TOPN.removeprefix('WITH ').rsplit('SELECT symbol, book, rank', 1)[0]}, f AS (SELECT symbol, CAST(sum(CASE WHEN book = 'BID' THEN size ELSE 0 END) AS BIGINT) AS bid_depth, CAST(sum(CASE WHEN book = 'ASK' THEN size ELSE 0 END) AS BIGINT) AS ask_depth
FROM r WHERE rank <= 5 GROUP BY symbol) SELECT *, CASE WHEN bid_depth + ask_depth > 0 THEN CAST(floor((bid_depth - ask_depth)::DOUBLE / (bid_depth + ask_depth) * 1e6 + 0.5) AS BIGINT) END AS imbalance FROM f""",
    ),
    "book_stats": (book_stats, STATS),
}
