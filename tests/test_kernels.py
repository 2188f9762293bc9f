import pytest
from pyspark.sql import functions as F

from tapeworks import catalog
from tapeworks.operators import asof, kernels, matching, windows

SF = "/root/testdata/sf0.001"


def seeded():
    book = kernels.PriceBook()
    for side, levels in (("BUY", [(9999, 500), (9998, 700), (9997, 300)]), ("SELL", [(10001, 400), (10002, 900), (10003, 250)])):
        for p, q in levels:
            book.apply("ADD", side, p, q)
    return book


def test_price_book():
    book = seeded()
    assert book.best("BUY") == 9999 and book.top("SELL", 2) == [(10001, 400), (10002, 900)]
    book.apply("TRADE", "BUY", 10001, 400)
    assert book.best("SELL") == 10002
    book.apply("SNAPSHOT", "SELL", 10001, 5)
    book.apply("CANCEL", "SELL", 10001, 5)
    for wrong in (("CANCEL", "BUY", 9999, 501), ("ADD", "BUY", 10005, 1), ("MODIFY", "BUY", 1, 1), ("ADD", None, 1, 1), ("ADD", "BUY", None, 1), ("NEW", "BUY", 1, 1), ("TRADE", None, 1, 1)):
        with pytest.raises(kernels.BookError):
            seeded().apply(*wrong)
    book = kernels.PriceBook(strict=False)
    book.apply("ADD", "BUY", 10, 5)
    book.apply("CANCEL", "BUY", 10, 9)
    assert book.best("BUY") is None and book.violations == 1
    book.apply("CLEAR", None, None, None)


def test_order_book():
    book = kernels.OrderBook()
    for k, q in ((1, 10), (2, 20), (3, 30)):
        book.add(k, "BUY", 100, q)
    assert book.ahead(3) == 30
    book.modify(1, 5)
    assert book.ahead(3) == 25 and book.ahead(1) == 0
    book.modify(1, 8)
    assert book.ahead(1) == 50
    assert book.trade("BUY", 100, 25) == [(2, 20), (3, 5)]
    book.replace(3, 101, 7)
    assert book.cancel(3) == 7 and book.ahead(1) == 0
    for wrong in (lambda: book.add(1, "BUY", 1, 1), lambda: book.cancel(9), lambda: book.cancel(1, 99), lambda: book.trade("BUY", 100, 99)):
        with pytest.raises(kernels.BookError):
            wrong()


def test_queue_places():
    p = kernels.QueuePlace("BUY", 9999, 100, 500)
    assert [p.trade(300), p.trade(150), p.trade(120)] == [0, 0, 70] and p.remaining == 30
    p = kernels.QueuePlace("SELL", 10001, 100, 400)
    assert p.trade(400) == 0 and p.ahead == 0 and p.remaining == 100
    for policy, level, ahead in (("optimistic", 900, 500), ("conservative", 900, 100), ("neutral", 1000, 300)):
        p = kernels.QueuePlace("BUY", 9999, 100, 500)
        p.cancelled(400, level, policy)
        assert p.ahead == ahead
    with pytest.raises(ValueError):
        p.cancelled(1, 1, "other")


def test_weights():
    assert kernels.weights("twap", 4) == [0.25] * 4
    assert kernels.weights("vwap", 2, [1, 2, 3, 2]) == [3 / 8, 5 / 8]
    w = kernels.weights("is", 10, kappa=0.3)
    assert sum(w) == pytest.approx(1) and w == sorted(w, reverse=True)
    assert kernels.weights("is", 5, kappa=0.0) == pytest.approx([0.2] * 5)
    for wrong in (("vwap", 3), ("none", 3)):
        with pytest.raises(ValueError):
            kernels.weights(*wrong)


@pytest.mark.parametrize("style", ["passive", "aggressive"])
@pytest.mark.parametrize("policy", ["twap", "vwap", "pov", "is"])
def test_execution_conserves(policy, style):
    x = kernels.Execution(kernels.Parent("BUY", 200, 100, 1000, policy, style, 4, 5, 0.5, 100, 150, profile=[1, 2]))
    for p, q in ((9999, 500), (9998, 700)):
        x.event(1, "ADD", "BUY", p, q)
    for p, q in ((10001, 4000), (10002, 900)):
        x.event(2, "ADD", "SELL", p, q)
    for t in range(110, 1100, 10):
        x.event(t, "TRADE", "SELL", 9999, 20)
        x.event(t, "ADD", "BUY", 9999, 20)
    x.finish()
    assert x.filled == sum(q for _, _, q, _ in x.fills) == 200 and x.working == 0
    assert x.arrival2 == 20000
    if style == "aggressive" and policy != "pov":
        assert {kind for *_, kind in x.fills} == {"TAKER"} and all(p == 10001 for _, p, _, _ in x.fills)


@pytest.mark.parametrize("name", [n for n, (_, sql) in catalog.ALL.items() if sql is None])
def test_machines_and_fits(spark, name):
    frame = catalog.queries()[name](spark, SF)
    rows = frame.collect()
    assert rows
    if name == "simulate_runs":
        assert all(0 <= r.filled <= r.requested and 0 <= r.maker <= r.filled for r in rows) and len({(r.symbol, r.policy, r.style) for r in rows}) == len(rows)
    if name == "block_bootstrap":
        assert all(r.low <= r.mean <= r.high for r in rows)


def test_ridge_is_the_closed_form(spark):
    import numpy as np

    from tapeworks.plans import research

    x = research._features(spark, SF).select("features", "y").collect()
    a = np.array([r.features.toArray() for r in x])
    y = np.array([r.y for r in x])
    w = np.linalg.solve(a.T @ a + np.eye(3), a.T @ (y - y.mean()))
    got = {r.term: r.value for r in research.ridge_fit(spark, SF).collect()}
    assert [got["x1"], got["x2"], got["x3"]] == pytest.approx(w.tolist(), abs=1e-6)


def test_sweep_forms_agree(spark):
    levels = spark.createDataFrame([(1, 101, 5), (1, 102, 20)], "o long, price long, size long")
    taken = {r.price: r.take for r in matching.sweep(levels.withColumn("q", F.lit(12)), ["o"], ["price"], "size", "q").collect()}
    assert taken == {101: 5, 102: 7}
    r = levels.groupBy("o").agg(F.array_sort(F.collect_list(F.struct("price", "size"))).alias("a")).select(matching.fold_sweep(F.col("a"), F.lit(12).cast("long")).alias("r")).first().r
    assert (r.filled, r.notional, r.n, r.worst) == (12, 5 * 101 + 7 * 102, 2, 102)


def test_asof_variants(spark):
    left = spark.createDataFrame([(1, t) for t in range(6)], "k long, at long")
    right = spark.createDataFrame([(1, 1, 1, 10), (1, 1, 2, 11), (1, 3, 3, 30)], "k long, mt long, s long, v long")
    got = lambda *a: [r.v for r in sorted(asof.asof_join(left, right, ["k"], "at", "mt", "s", ["v"], *a).collect(), key=lambda r: r.at)]
    assert got("backward", True) == [None, 11, 11, 30, 30, 30]
    assert got("backward", False) == [None, None, 11, 11, 30, 30]
    assert got("forward", True) == [10, 10, 30, 30, None, None]
    with pytest.raises(ValueError):
        got("sideways")


def test_interval_join_and_trailing(spark):
    points = spark.createDataFrame([(1, t) for t in range(0, 100, 7)], "k long, t long")
    spans = spark.createDataFrame([(1, 0, 0, 35), (1, 1, 34, 64)], "k long, run long, a long, b long")
    found = {(r.run, r.t) for r in asof.interval_join(points, spans, ["k"], "t", "a", "b", 10).collect()}
    assert found == {(run, t) for run, a, b in ((0, 0, 35), (1, 34, 64)) for t in range(0, 100, 7) if a <= t <= b}
    rows = spark.createDataFrame([(1, 0, 1, 10), (1, 0, 2, 20), (1, 5, 3, 5)], "k long, t long, s long, v long")
    got = [r.x for r in windows.trailing(rows, ["k"], "t", "s", 5, {"x": F.col("v")}).orderBy("s").collect()]
    assert got == [10, 30, 35]
