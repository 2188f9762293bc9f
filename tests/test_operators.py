"""Windows over bucket ends, hot keys, matching, fees, guards, validation and statistics on small cases."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tapeworks.functions import fees, tca
from tapeworks.functions.instrument import Instrument
from tapeworks.operators import asof, matching, windows
from tapeworks.plans import costmodel, labels, orders, research, validation


@pytest.fixture(scope="module")
def series(spark):
    """One key holds most rows; times repeat and reach over many buckets."""
    draw = random.Random(3)
    rows = [(0 if draw.random() < 0.8 else draw.randrange(1, 4), draw.randrange(200), s, draw.choice([None, 1, 2, 5])) for s in range(400)]
    return rows, spark.createDataFrame(rows, "k long, t long, s long, v long")


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1], r[2]))


def test_windows_equal_brute_force(series):
    rows, frame = series
    order = ["t", "s"]
    got = {r.s: r for r in windows.known(frame, ["k"], order, {"x": F.col("v")}, 16).collect()}
    sums = {r.s: r.x for r in windows.cumulative(frame, ["k"], order, {"x": F.col("v")}, 16).collect()}
    before = {r.s: (r.p_s, r.p_v) for r in windows.previous(frame, ["k"], order, ["s", "v"], width=16).collect()}
    tops = {r.s: r.x for r in windows.highest_before(frame, ["k"], order, {"x": F.col("v")}, 16).collect()}
    numbers = {r.s: (r.k, r.n) for r in windows.numbered(frame.withColumnRenamed("k", "key"), ["key"], order, 16).collect()}
    near = {r.s: r.x for r in windows.trailing(frame, ["k"], "t", "s", 20, {"x": F.col("v")}).collect()}
    for k, t, s, v in rows:
        mine = [r for r in in_order(rows) if r[0] == k]
        at = mine.index((k, t, s, v))
        upto = [r[3] for r in mine[: at + 1] if r[3] is not None]
        assert got[s].x == (upto[-1] if upto else None) and sums[s] == sum(upto)
        assert before[s] == ((mine[at - 1][2], mine[at - 1][3]) if at else (None, None))
        assert tops[s] == max([r[3] for r in mine[:at] if r[3] is not None], default=None)
        assert numbers[s] == (at, len(mine))
        assert near[s] == sum(r[3] or 0 for r in mine[: at + 1] if r[1] >= t - 20)


def test_interval_sums(spark, series):
    rows, frame = series
    spans = [(k, i, a, a + w) for i, (k, a, w) in enumerate([(0, 0, 500), (0, 50, 0), (1, 30, 60), (2, 190, 5), (9, 0, 10)])]
    found = asof.interval_sums(frame, spark.createDataFrame(spans, "k long, run long, a long, b long"), ["k"], "t", "s", "a", "b", {"x": F.col("v"), "n": F.lit(1)}, 16)
    want = {i: (sum(r[3] or 0 for r in rows if r[0] == k and a <= r[1] <= b), sum(r[0] == k and a <= r[1] <= b for r in rows)) for k, i, a, b in spans}
    assert {r.run: (r.x, r.n) for r in found.collect()} == want


def test_match(spark):
    levels = [(10, 5), (11, 5), (13, 10)]
    cases = [(8, None, "DAY", None, (8, 0, 2, 83, 11)), (8, 10, "DAY", None, (5, 3, 1, 50, 10)), (30, None, "IOC", None, (20, 0, 3, 235, 13)), (30, None, "FOK", None, (0, 30, 0, 0, None)), (30, None, "DAY", 1, (5, 25, 1, 50, 10)), (8, 9, "DAY", None, (0, 8, 0, 0, None))]
    rows = [(i, p, s, q, lim, tif, cap) for i, (q, lim, tif, cap, _) in enumerate(cases) for p, s in levels]
    frame = spark.createDataFrame(rows, "o long, price long, size long, quantity long, lim long, tif string, cap long")
    got = matching.match(frame, ["o"], F.lit(True), "price", "size", "quantity", "lim", "tif", "cap").orderBy("o").collect()
    assert [(r.filled, r.remaining, r.levels, r.notional, r.worst) for r in got] == [c[-1] for c in cases]


def test_marketable(spark):
    rows = [(True, None, 10), (True, 10, 10), (True, 9, 10), (False, 10, 10), (False, 11, 10), (True, 12, None)]
    frame = spark.createDataFrame(rows, "buys boolean, lim long, touch long")
    assert [r[0] for r in frame.select(matching.is_marketable(F.col("buys"), F.col("lim"), F.col("touch"))).collect()] == [True, True, False, True, False, False]


def test_fees(spark):
    s = fees.Schedule(taker=300, maker=100, rebate=150, per_unit=3, minimum=100)
    rows = [("TAKER", 0, 10), ("MAKER", 10, 10), ("UNKNOWN", 20, 20), ("TAKER", 40, 1), ("TAKER", 0, 0)]
    frame = spark.createDataFrame(rows, "liquidity string, before long, qty long")
    got = frame.select(s.exchange(F.lit(1000), F.col("liquidity")).alias("e"), s.commission(F.col("qty"), F.col("before")).alias("c")).collect()
    assert [r.e for r in got] == [300000, -50000, 300000, 300000, 300000]
    assert [r.c for r in got] == [100, 0, 20, 3, 0] and sum(r.c for r in got[:4]) == 3 * 41
    with pytest.raises(ValueError):
        fees.Schedule(taker=-1)


def test_markout_without_price(spark):
    rows = spark.createDataFrame([(0, 10, "BUY"), (100, 99, "BUY"), (100, 99, "SELL"), (100, None, "BUY")], "p long, later long, side string")
    assert [r[0] for r in rows.select(tca.markout_bps(F.col("p"), F.col("later"), F.col("side"))).collect()] == [None, 100.0, -100.0, None]


def test_instrument(spark):
    prices = ["10.00", "10.02", "10.025", "10.074", "10.075", "0.02"]
    frame = spark.createDataFrame([(Decimal(p),) for p in prices], "p decimal(18,3)")
    assert [r[0] for r in frame.select(Instrument().to_ticks(F.col("p"))).collect()] == [200, 200, 201, 201, 202, 0]
    with pytest.raises(ValueError):
        Instrument(lot=0)


def test_sign_test(spark):
    def exact(w, n):
        tail = sum(math.comb(w + n, i) for i in range(min(w, n) + 1))
        return min(1.0, 2 * tail / 2 ** (w + n)) if w + n else 1.0

    cases = [(0, 0), (0, 5), (5, 0), (3, 3), (8, 2), (21, 19), (400, 330), (5000, 5100)]
    frame = spark.createDataFrame(cases, "w long, l long")
    got = [r[0] for r in frame.select(research.sign_test(F.col("w"), F.col("l"))).collect()]
    assert got == pytest.approx([exact(*c) for c in cases], rel=1e-9)


def test_guards_trip(spark):
    rows = [(1, 1, 1, 40, 10, 0), (1, 2, 1, 50, 10, 0), (1, 3, 1, 1, 10, 0), (2, 1, -1, 40, 10, 100), (3, 1, 1, 0, 1, 0)]
    frame = spark.createDataFrame(rows, "run_id long, n long, sign long, qty long, price long, volume long")
    got = {(r.run_id, r.n): r.reason for r in orders.decisions(frame).collect()}
    assert got == {(1, 1): None, (1, 2): "child_size", (1, 3): "kill_switch", (2, 1): "participation", (3, 1): "quantity"}
    lenient = orders.decisions(frame, orders.Limits(kill_switch=False)).where("run_id = 1 AND n = 3").first()
    assert lenient.reason is None


def test_transitions(spark):
    frame = spark.createDataFrame([(None, "NEW"), (None, "FILLED"), ("NEW", "FILLED"), ("ACCEPTED", "FILLED"), ("FILLED", "CANCELLED"), ("CANCEL_PENDING", "FILLED")], "a string, b string")
    assert [r[0] for r in frame.select(orders.is_allowed(F.col("a"), F.col("b"))).collect()] == [True, False, False, True, False, True]


def test_validation_modes(spark, sf):
    with pytest.raises(validation.ValidationError):
        validation.validate(spark, sf)
    with pytest.raises(ValueError):
        validation.validate(spark, sf, "LOOSE")
    rows = {r.arrival: r for r in validation.arrivals(spark, sf).collect()}
    last: dict = {}
    want = set()
    for a in sorted(rows):  # one state machine per session
        r = rows[a]
        t, seq = last.get(r.session, (None, None))
        fine = (t is None or r.t >= t) and (seq is None or r.seq > seq) and r.symbol == r.session and r.price > 0 and r.qty is not None and r.qty > 0
        fine = fine and not (r.kind in ("ADD", "CANCEL") and r.side is None) and r.flags != 3
        if fine:
            last[r.session] = (r.t, r.seq)
            want.add(a)
    assert {r.arrival for r in validation.validate(spark, sf, "REPAIR").select("arrival").collect()} == want


def test_embargo_and_split(spark):
    assert labels.embargo_rows(10, 3, 4) == 3 and labels.embargo_rows(0, 0, 1) == 0
    frame = spark.createDataFrame([(1, t) for t in range(100)], "k1 long, t long")
    parts = labels.split(frame, ["k1"], ["t"], 5)
    got = {p: sorted(r.t for r in parts.collect() if r.part == p) for p in ("train", "validation", "test")}
    assert got == {"train": list(range(55)), "validation": list(range(60, 75)), "test": list(range(80, 100))}
    labels.check_split(parts, ["k1", "t"])
    with pytest.raises(ValueError):
        labels.check_split(parts.unionByName(parts.withColumn("part", F.lit("test"))), ["k1", "t"])
    with pytest.raises(ValueError):
        labels.split(frame, ["k1"], ["t"], 5, (98, 1, 1))


def test_upper_median(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), ("b", 5), ("b", 9), ("c", None)], "g string, v long")
    assert {(r.g, r.v, r.n) for r in costmodel.upper_median(frame, ["g"], "v").collect()} == {("a", 2, 2), ("b", 5, 3)}


def test_latency_and_impact_models(spark):
    with pytest.raises(ValueError):
        costmodel.latency("guessed")
    with pytest.raises(ValueError):
        costmodel.impact(F.lit(1.0), F.lit(1.0), "cubic")
    assert spark.range(50).select(costmodel.latency("lognormal").alias("x")).where("x > 0").count() == 50
