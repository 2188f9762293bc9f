"""Validation of an event stream: eight rules in order, three modes, counters and exported issues.

An arrival stream is made of the events: one in 131 arrives twice, prices, quantities, sides, flags
and symbols of some are spoiled, and arrival order (the event's number) differs from event time.
The first rule a row breaks counts. Order rules compare with the last accepted row: in WARN mode any
row, in REPAIR mode one that was sound itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.operators import windows
from tapeworks.sources import market as M

#: Flags of the side that took, as bits.
AGGRESSOR_BUY, AGGRESSOR_SELL = 1, 2
#: Arrivals in a bucket of the ordered passes; issues a report exports for each session.
WIDTH, EXPORTED = 1 << 14, 100
PRICED = ("BID", "ASK", "ADD", "CANCEL", "TRADE")


class ValidationError(ValueError):
    """A row that STRICT mode refuses."""


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, arrival (twice the number, the copy one more), seq, t, symbol, kind, side, price, qty, flags."""
    e = M.events(spark, sf_dir)
    seq = F.col("seq")
    copies = F.when(seq % 131 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return e.select(
        F.col("symbol").alias("session"),
        "seq",
        "t",
        F.when(seq % 211 == 0, F.col("symbol") + 1).otherwise(F.col("symbol")).alias("symbol"),
        "kind",
        F.when(seq % 61 != 0, F.col("side")).alias("side"),
        F.when(seq % 97 == 0, 0).otherwise(F.col("price")).alias("price"),
        F.when(seq % 89 != 0, F.col("qty")).alias("qty"),
        F.when(seq % 173 == 0, 3).when(F.col("side") == "BUY", AGGRESSOR_BUY).otherwise(AGGRESSOR_SELL).alias("flags"),
        F.explode(copies).alias("copy"),
    ).select((seq * 2 + F.col("copy")).alias("arrival"), "*")


ARRIVALS = f"""{M.EVENTS}, ar AS (SELECT seq * 2 + copy AS arrival, * FROM (
  SELECT symbol AS session, seq, t, CASE WHEN seq % 211 = 0 THEN symbol + 1 ELSE symbol END AS symbol, kind, CASE WHEN seq % 61 <> 0 THEN side END AS side,
    CASE WHEN seq % 97 = 0 THEN 0 ELSE price END AS price, CASE WHEN seq % 89 <> 0 THEN qty END AS qty,
    CASE WHEN seq % 173 = 0 THEN 3 WHEN side = 'BUY' THEN 1 ELSE 2 END AS flags, unnest(CASE WHEN seq % 131 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM ev))"""


def own_rules():
    """The first rule that a row breaks by itself."""
    flags = F.col("flags")
    priced = F.col("kind").isin(*PRICED)
    return (
        F.when(F.col("symbol") != F.col("session"), "symbol_mismatch")
        .when(priced & (F.col("price").isNull() | (F.col("price") <= 0)), "invalid_price")
        .when(priced & (F.col("qty").isNull() | (F.col("qty") <= 0)), "invalid_quantity")
        .when(F.col("kind").isin("ADD", "CANCEL") & F.col("side").isNull(), "missing_side")
        .when((flags.bitwiseAND(AGGRESSOR_BUY) != 0) & (flags.bitwiseAND(AGGRESSOR_SELL) != 0), "conflicting_aggressor_flags")
    )


OWN = """CASE WHEN symbol <> session THEN 'symbol_mismatch' WHEN price IS NULL OR price <= 0 THEN 'invalid_price' WHEN qty IS NULL OR qty <= 0 THEN 'invalid_quantity'
  WHEN kind IN ('ADD', 'CANCEL') AND side IS NULL THEN 'missing_side' WHEN flags & 1 <> 0 AND flags & 2 <> 0 THEN 'conflicting_aggressor_flags' END"""


def order_rules(t: str, seq: str):
    """The order rule a row breaks against the last accepted time and number."""
    return F.when(F.col("t") < F.col(t), "out_of_order_timestamp").when(F.col("seq") == F.col(seq), "duplicate_sequence_id").when(F.col("seq") < F.col(seq), "sequence_not_monotonic")


def warned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows with ``code``, null for sound ones; the last accepted row is the row before."""
    a = windows.previous(arrivals(spark, sf_dir), ["session"], ["arrival"], ["t", "seq"], width=WIDTH)
    return a.withColumn("code", F.coalesce(order_rules("p_t", "p_seq"), own_rules()))


WARNED = f"""{ARRIVALS}, wa AS (SELECT *, CASE WHEN t < lag(t) OVER w THEN 'out_of_order_timestamp' WHEN seq = lag(seq) OVER w THEN 'duplicate_sequence_id' WHEN seq < lag(seq) OVER w THEN 'sequence_not_monotonic'
  ELSE {OWN} END AS code FROM ar WINDOW w AS (PARTITION BY session ORDER BY arrival))"""


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows with ``code``; those with one are dropped, so the last accepted row is the sound row
    of the greatest time before (numbers rise with arrival, but for copies, which follow at once)."""
    a = arrivals(spark, sf_dir).withColumn("own", own_rules())
    sound = F.col("own").isNull()
    a = windows.highest_before(a, ["session"], ["arrival"], {"top": F.when(sound, F.col("t"))}, WIDTH)
    in_time = sound & (F.col("top").isNull() | (F.col("t") >= F.col("top")))
    a = windows.highest_before(a, ["session"], ["arrival"], {"last_seq": F.when(in_time, F.col("seq"))}, WIDTH)
    return a.withColumn("code", F.coalesce(order_rules("top", "last_seq"), F.col("own")))


REPAIRED = f"""{ARRIVALS}, ow AS (SELECT *, {OWN} AS own FROM ar),
tp AS (SELECT *, max(CASE WHEN own IS NULL THEN t END) OVER (PARTITION BY session ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ow),
ls AS (SELECT *, max(CASE WHEN own IS NULL AND (top IS NULL OR t >= top) THEN seq END) OVER (PARTITION BY session ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_seq FROM tp),
re AS (SELECT *, CASE WHEN t < top THEN 'out_of_order_timestamp' WHEN seq = last_seq THEN 'duplicate_sequence_id' WHEN seq < last_seq THEN 'sequence_not_monotonic' ELSE own END AS code FROM ls)"""


def validate(spark: SparkSession, sf_dir: str, mode: str = "STRICT") -> DataFrame:
    """The accepted rows: in WARN mode all, in REPAIR mode the sound ones; STRICT raises at the first."""
    if mode == "WARN":
        return warned(spark, sf_dir).drop("p_t", "p_seq")
    if mode == "REPAIR":
        return repaired(spark, sf_dir).where("code IS NULL").drop("own", "top", "last_seq")
    if mode != "STRICT":
        raise ValueError(f"mode must be STRICT, WARN or REPAIR, not {mode!r}")
    rows = warned(spark, sf_dir)
    first = rows.where("code IS NOT NULL").agg(F.min(F.struct("session", "arrival", "code", "seq")).alias("m")).first()["m"]
    if first is not None:
        raise ValidationError(f"{first['code']} (seq={first['seq']}, session={first['session']})")
    return rows.drop("p_t", "p_seq")


def validation_warn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warned(spark, sf_dir).select("session", "arrival", "code")


def validation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repaired(spark, sf_dir).where("code IS NULL")
    return kept.groupBy("session").agg(F.count("*").alias("accepted"), F.max("t").alias("last_t"), F.sum("qty").alias("quantity"))


def validation_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each code in both lenient modes, with what went in and came out."""
    w = warned(spark, sf_dir).groupBy(F.lit("WARN").alias("mode"), "session", F.coalesce("code", F.lit("accepted")).alias("code")).agg(F.count("*").alias("n"))
    r = repaired(spark, sf_dir).groupBy(F.lit("REPAIR").alias("mode"), "session", F.coalesce("code", F.lit("accepted")).alias("code")).agg(F.count("*").alias("n"))
    return w.unionByName(r)


COUNTERS = f"""WITH {WARNED}{REPAIRED.removeprefix(ARRIVALS)}
SELECT 'WARN' AS mode, session, coalesce(code, 'accepted') AS code, count(*) AS n FROM wa GROUP BY ALL UNION ALL SELECT 'REPAIR', session, coalesce(code, 'accepted'), count(*) FROM re GROUP BY ALL"""


def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report exports: the first issues of each session, and what was done about each."""
    w = Window.partitionBy("session").orderBy("arrival")
    ranked = repaired(spark, sf_dir).where("code IS NOT NULL").select("session", F.row_number().over(w).alias("rank"), "code", "seq", F.lit("dropped").alias("action"))
    return ranked.where(F.col("rank") <= EXPORTED)  # a top-k window: Spark keeps no more of a session


ISSUES = f"""WITH {REPAIRED} SELECT session, rank::INTEGER AS rank, code, seq, 'dropped' AS action FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY arrival) AS rank FROM re WHERE code IS NOT NULL) WHERE rank <= {EXPORTED}"""


def aggressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side that took: by flag, else the event's own side, else null."""
    flags = F.when(F.col("seq") % 7 == 0, 0).otherwise(F.col("flags"))
    side = F.when(flags.bitwiseAND(AGGRESSOR_BUY) != 0, "BUY").when(flags.bitwiseAND(AGGRESSOR_SELL) != 0, "SELL").otherwise(F.col("side"))
    return arrivals(spark, sf_dir).where("kind = 'TRADE'").select("session", "arrival", side.alias("aggressor"))


AGGRESSOR = f"""WITH {ARRIVALS}, f AS (SELECT *, CASE WHEN seq % 7 = 0 THEN 0 ELSE flags END AS fl FROM ar WHERE kind = 'TRADE')
SELECT session, arrival, CASE WHEN fl & 1 <> 0 THEN 'BUY' WHEN fl & 2 <> 0 THEN 'SELL' ELSE side END AS aggressor FROM f"""

QUERIES = {
    "validation_warn": (validation_warn, f"WITH {WARNED} SELECT session, arrival, code FROM wa"),
    "validation_repair": (validation_repair, f"WITH {REPAIRED} SELECT session, count(*) AS accepted, max(t) AS last_t, CAST(sum(qty) AS BIGINT) AS quantity FROM re WHERE code IS NULL GROUP BY session"),
    "validation_counters": (validation_counters, COUNTERS),
    "validation_issues": (validation_issues, ISSUES),
    "aggressor_resolution": (aggressor, AGGRESSOR),
}
