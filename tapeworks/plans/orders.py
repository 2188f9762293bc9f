"""Orders against books: matching with limits and times in force, guards, the order life cycle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.operators import matching
from tapeworks.plans import books
from tapeworks.sources import market as M

#: (quantity, levels beyond the touch that a limit allows or null, time in force, level cap or null).
ORDERS = (
    (50, None, "DAY", None),
    (500, None, "DAY", None),
    (100000, None, "DAY", None),
    (500, 1, "DAY", None),
    (500, -1, "DAY", None),
    (100000, None, "IOC", None),
    (100000, None, "FOK", None),
    (50, None, "FOK", None),
    (100000, None, "DAY", 2),
    (100000, 2, "IOC", 3),
)


def _orders() -> Column:
    none = F.lit(None).cast("long")
    rows = [
        F.struct(F.lit(q).cast("long").alias("quantity"), (none if d is None else F.lit(d).cast("long")).alias("offset"), F.lit(f).alias("tif"), (none if c is None else F.lit(c).cast("long")).alias("cap"), F.lit(k).alias("order"))
        for k, (q, d, f, c) in enumerate(ORDERS)
    ]
    return F.array(*rows)


_ORDERS = ", ".join(f"({k}, {q}::BIGINT, {'NULL' if d is None else d}::BIGINT, '{f}', {'NULL' if c is None else c}::BIGINT)" for k, (q, d, f, c) in enumerate(ORDERS))


def match_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders walking each side of the final books: what they take under limit, level cap and time in
    force, whether they could trade at all, and where they would rest."""
    levels = books._final(spark, sf_dir)
    touch = levels.groupBy("symbol", "book").agg(F.min(F.when(F.col("book") == "ASK", F.col("level"))).alias("a"), F.max(F.when(F.col("book") == "BID", F.col("level"))).alias("b"))
    o = levels.join(touch.select("symbol", "book", F.coalesce("a", "b").alias("touch")), ["symbol", "book"]).select("*", F.explode(_orders()).alias("o"))
    away = F.when(F.col("book") == "ASK", 1).otherwise(-1)
    o = o.select("symbol", "book", "level", "size", "touch", "o.*").withColumn("limit", F.col("touch") + away * F.col("offset"))
    met = matching.match(o, ["symbol", "book", "order"], F.col("book") == "ASK", "level", "size", "quantity", "limit", "tif", "cap")
    first = o.groupBy("symbol", "book", "order").agg(F.first("touch").alias("touch"), F.first("limit").alias("limit"))
    return met.join(first, ["symbol", "book", "order"]).select("symbol", "book", "order", "filled", "remaining", "levels", "notional", "worst", matching.is_marketable(F.col("book") == "ASK", F.col("limit"), F.col("touch")).alias("marketable"))


MATCHES = f"""WITH {books.FINAL}, tt AS (SELECT symbol, book, CASE WHEN book = 'ASK' THEN min(level) ELSE max(level) END AS touch FROM fi GROUP BY symbol, book),
oo AS (SELECT fi.*, touch, o.*, touch + CASE WHEN fi.book = 'ASK' THEN 1 ELSE -1 END * "offset" AS lim FROM fi JOIN tt USING (symbol, book), (VALUES {_ORDERS}) AS o("order", quantity, "offset", tif, cap)),
rk AS (SELECT *, row_number() OVER w AS rank, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM oo WINDOW w AS (PARTITION BY symbol, book, "order" ORDER BY CASE WHEN book = 'ASK' THEN level ELSE -level END)),
tk AS (SELECT *, CASE WHEN (lim IS NULL OR (book = 'ASK' AND level <= lim) OR (book = 'BID' AND level >= lim)) AND (cap IS NULL OR rank <= cap) THEN greatest(0, least(size, quantity - before)) ELSE 0 END AS take FROM rk),
su AS (SELECT symbol, book, "order", any_value(quantity) AS quantity, any_value(tif) AS tif, any_value(touch) AS touch, any_value(lim) AS lim, CAST(sum(take) AS BIGINT) AS f, count(CASE WHEN take > 0 THEN 1 END) AS n, CAST(sum(take * level) AS BIGINT) AS v,
  CASE WHEN book = 'ASK' THEN max(CASE WHEN take > 0 THEN level END) ELSE min(CASE WHEN take > 0 THEN level END) END AS w FROM tk GROUP BY symbol, book, "order"),
fk AS (SELECT *, tif = 'FOK' AND f < quantity AS none FROM su)
SELECT symbol, book, "order", CASE WHEN none THEN 0 ELSE f END AS filled, CASE WHEN none THEN quantity WHEN tif = 'IOC' THEN 0 ELSE quantity - f END AS remaining, CASE WHEN none THEN 0 ELSE n END AS levels, CASE WHEN none THEN 0 ELSE v END AS notional,
  CASE WHEN none THEN NULL ELSE w END AS worst, lim IS NULL OR (book = 'ASK' AND lim >= touch) OR (book = 'BID' AND lim <= touch) AS marketable FROM fk"""


@dataclass(frozen=True)
class Limits:
    """Guardrails: of a child order, of a run's open orders, of its inventory, of its share of the market."""

    child: int = 45
    open_orders: int = 5
    inventory: int = 150
    notional: int = 8_000_000
    participation: float = 0.25
    kill_switch: bool = True


def decisions(children: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``reason`` a guard refuses each child of a run for, null if none does. With the kill switch a
    run's first breach stops all that follows. Children need run_id, n, side sign, qty, price, volume.

    A run's windows are over its own children: as many as one parent order has.
    """
    before = Window.partitionBy("run_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("run_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    projected = F.abs(F.sum(F.col("sign") * F.col("qty")).over(upto))
    own = (
        F.when(F.col("qty") <= 0, "quantity")
        .when(F.col("qty") > limits.child, "child_size")
        .when(F.col("n") - 1 >= limits.open_orders, "open_orders")
        .when(projected > limits.inventory, "inventory")
        .when(F.col("price") * F.col("qty") > limits.notional, "notional")
        .when((F.col("volume") > 0) & (F.sum("qty").over(upto) > F.col("volume") * F.lit(limits.participation)), "participation")
    )
    x = children.withColumn("own", own)
    if not limits.kill_switch:
        return x.withColumnRenamed("own", "reason")
    tripped = F.max(F.col("own").isNotNull().cast("int")).over(before) == 1
    return x.withColumn("reason", F.when(tripped, "kill_switch").otherwise(F.col("own"))).drop("own")


def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fills of each run as the children that a guard would have seen."""
    f = M.fills(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("run_id").orderBy("t", "fill", "price", "qty", "l_partkey"))
    volume = M.executions(spark, sf_dir).select("run_id", "market_volume")
    children = f.join(volume, "run_id").select("run_id", n.alias("n"), F.when(F.col("side") == "BUY", 1).otherwise(-1).alias("sign"), "qty", "price", F.col("market_volume").alias("volume"))
    d = decisions(children)
    return d.groupBy(F.coalesce("reason", F.lit("allowed")).alias("decision")).agg(F.count("*").alias("n"), F.sum("qty").alias("quantity"), F.countDistinct("run_id").alias("runs"))


_L = Limits()
GUARDS = f"""WITH {M.EXECUTIONS}, ch AS (SELECT fl.run_id, row_number() OVER (PARTITION BY fl.run_id ORDER BY t, fill, price, qty, l_partkey) AS n, CASE WHEN fl.side = 'BUY' THEN 1 ELSE -1 END AS sign, qty, price, market_volume AS volume FROM fl JOIN ex USING (run_id)),
ow AS (SELECT *, CASE WHEN qty <= 0 THEN 'quantity' WHEN qty > {_L.child} THEN 'child_size' WHEN n - 1 >= {_L.open_orders} THEN 'open_orders' WHEN abs(sum(sign * qty) OVER w) > {_L.inventory} THEN 'inventory' WHEN price * qty > {_L.notional} THEN 'notional'
  WHEN volume > 0 AND sum(qty) OVER w > volume * {_L.participation}::DOUBLE THEN 'participation' END AS own FROM ch WINDOW w AS (PARTITION BY run_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
de AS (SELECT *, CASE WHEN max(CASE WHEN own IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 THEN 'kill_switch' ELSE own END AS reason FROM ow)
SELECT coalesce(reason, 'allowed') AS decision, count(*) AS n, CAST(sum(qty) AS BIGINT) AS quantity, count(DISTINCT run_id) AS runs FROM de GROUP BY ALL"""

#: The statuses that may follow each status of an order.
TRANSITIONS = {
    "NEW": ("ACCEPTED", "REJECTED", "CANCELLED"),
    "ACCEPTED": ("PARTIALLY_FILLED", "FILLED", "CANCEL_PENDING", "CANCELLED", "EXPIRED"),
    "PARTIALLY_FILLED": ("PARTIALLY_FILLED", "FILLED", "CANCEL_PENDING", "CANCELLED", "EXPIRED"),
    "CANCEL_PENDING": ("CANCELLED", "PARTIALLY_FILLED", "FILLED"),
    "FILLED": (),
    "CANCELLED": (),
    "REJECTED": (),
    "EXPIRED": (),
}


def is_allowed(before: Column, after: Column) -> Column:
    """Whether an order may go from one status to another; null for its first, which must be NEW."""
    rule = F.when(before.isNull(), after == "NEW")
    for status, following in TRANSITIONS.items():
        rule = rule.when(before == status, after.isin(*following) if following else F.lit(False))
    return rule.otherwise(F.lit(False))


def client_id(parent: Column, slice_number: Column, order_number: Column) -> Column:
    return F.format_string("%s-%04d-%06d", parent.cast("string"), slice_number.cast("int"), order_number.cast("int"))


def order_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status reports of each run's order: new, accepted, a report a fill, and what ended it. Every
    fiftieth run's last report comes once more, which no order may do."""
    f = M.fills(spark, sf_dir)
    w = Window.partitionBy("run_id").orderBy("t", "fill", "price", "qty", "l_partkey")
    filled = f.select("run_id", (F.row_number().over(w) + 1).alias("n"), F.sum("qty").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("qty").over(Window.partitionBy("run_id")).alias("all"))
    wanted = F.col("all") + F.col("run_id") % 7
    status = F.when(F.col("upto") >= wanted, "FILLED").otherwise("PARTIALLY_FILLED")
    reports = filled.select("run_id", "n", status.alias("status"))
    runs = filled.groupBy("run_id").agg(F.count("*").alias("k"))
    last = F.when(F.col("run_id") % 7 == 0, "FILLED").otherwise("CANCELLED")
    extra = F.array(
        F.struct(F.lit(0).cast("long").alias("n"), F.lit("NEW").alias("status")),
        F.struct(F.lit(1).cast("long").alias("n"), F.lit("ACCEPTED").alias("status")),
        F.when(F.col("run_id") % 7 != 0, F.struct((F.col("k") + 2).alias("n"), F.lit("CANCELLED").alias("status"))),
        F.when(F.col("run_id") % 50 == 0, F.struct((F.col("k") + 3).alias("n"), last.alias("status"))),
    )
    ends = runs.select("run_id", F.explode(F.array_compact(extra)).alias("r")).select("run_id", "r.n", "r.status")
    return reports.select("run_id", F.col("n").cast("long").alias("n"), "status").unionByName(ends)


REPORTS = f"""{M.FILLS}, fr AS (SELECT run_id, row_number() OVER w + 1 AS n, sum(qty) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(qty) OVER (PARTITION BY run_id) AS total FROM fl WINDOW w AS (PARTITION BY run_id ORDER BY t, fill, price, qty, l_partkey)),
rn AS (SELECT run_id, count(*) AS k FROM fl GROUP BY run_id),
rp AS (SELECT run_id, n, CASE WHEN upto >= total + run_id % 7 THEN 'FILLED' ELSE 'PARTIALLY_FILLED' END AS status FROM fr
  UNION ALL SELECT run_id, 0, 'NEW' FROM rn UNION ALL SELECT run_id, 1, 'ACCEPTED' FROM rn UNION ALL SELECT run_id, k + 2, 'CANCELLED' FROM rn WHERE run_id % 7 <> 0
  UNION ALL SELECT run_id, k + 3, CASE WHEN run_id % 7 = 0 THEN 'FILLED' ELSE 'CANCELLED' END FROM rn WHERE run_id % 50 = 0)"""


def order_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each status follows each, whether it may, and the least order it happened to."""
    w = Window.partitionBy("run_id").orderBy("n")
    steps = order_reports(spark, sf_dir).withColumn("before", F.lag("status").over(w))
    steps = steps.withColumn("allowed", is_allowed(F.col("before"), F.col("status")))
    first = client_id(F.min("run_id"), F.lit(0), F.min("run_id") % 1000000).alias("first_order")
    return steps.groupBy(F.coalesce("before", F.lit("-")).alias("before"), F.col("status").alias("after"), "allowed").agg(F.count("*").alias("n"), first)


_ALLOWED = " ".join(f"WHEN before = '{s}' THEN " + (f"status IN ({', '.join(repr(t) for t in f)})" if f else "false") for s, f in TRANSITIONS.items())
AUDIT = f"""WITH {REPORTS}, st AS (SELECT *, lag(status) OVER (PARTITION BY run_id ORDER BY n) AS before FROM rp)
SELECT coalesce(before, '-') AS before, status AS "after", CASE WHEN before IS NULL THEN status = 'NEW' {_ALLOWED} ELSE false END AS allowed, count(*) AS n, printf('%d-%04d-%06d', min(run_id), 0, min(run_id) % 1000000) AS first_order
FROM st GROUP BY ALL"""


def fills_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without fills, fills without an order, and runs by how much of them was filled."""
    orders, lines = M.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id")), M.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"))
    count = lambda frame, name: frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return (
        count(orders.join(lines, "run_id", "left_anti"), "orders_without_fills")
        .unionByName(count(orders.join(lines, "run_id", "left_semi"), "orders_with_fills"))
        .unionByName(count(lines.join(orders, "run_id", "left_anti"), "fills_without_order"))
    )


FILLS_AUDIT = """SELECT 'orders_without_fills' AS what, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'orders_with_fills', count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'fills_without_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)"""


def resting_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where passive orders of each side would join, at the touch and two levels behind it."""
    b = books.best_bid_ask(spark, sf_dir).select("symbol", F.explode(F.array(F.lit(0), F.lit(2))).alias("offset"), "bid", "ask")
    return b.select("symbol", "offset", (F.col("bid") - F.col("offset")).alias("buy"), (F.col("ask") + F.col("offset")).alias("sell"))


RESTING = f"SELECT symbol, o AS \"offset\", bid - o AS buy, ask + o AS sell FROM ({books.BEST}), (SELECT unnest([0, 2]) AS o)"

QUERIES = {
    "match_orders": (match_orders, MATCHES),
    "guard_decisions": (guards, GUARDS),
    "order_audit": (order_audit, AUDIT),
    "fills_audit": (fills_audit, FILLS_AUDIT),
    "resting_price": (resting_price, RESTING),
}
