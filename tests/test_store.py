"""The eight tables, adapters, the command line, exact queues, experiments."""

import random

import pytest

from tapeworks import __main__ as cli
from tapeworks.operators import kernels
from tapeworks.plans import experiments, simulation
from tapeworks.sources import adapters, tables


def test_store_and_dependencies(spark, sf, tmp_path):
    held = tables.fill_store(spark, sf, f"file://{tmp_path}/store")
    assert {n for n, there in held.status().items() if there} == set(tables.FILLED)
    x, m = held.read("executions"), held.read("tca_metrics")
    assert x.schema.names == tables.SCHEMAS["executions"].names and x.count() == m.count() > 0
    assert held.read("markouts").count() == 0
    sql = "SELECT e.policy, avg(t.cost_vs_arrival_bps) AS c FROM executions e JOIN tca_metrics t USING (run_id, seed) -- markouts\nGROUP BY e.policy"
    assert tables.dependencies(sql) == {"executions", "tca_metrics"} and tables.missing(held, sql) == []
    assert tables.missing(held, "SELECT * FROM markouts, my_fills WHERE x = 'datasets'") == ["markouts"]
    held.views()
    assert spark.sql(sql).count() > 1


def test_adapters(spark, tmp_path):
    path = str(tmp_path / "day.csv")
    with open(path, "w") as f:
        f.write("sequence_id,exchange_timestamp_ns,symbol,event_type,side,price_ticks,quantity_base\n1,10,A,add,buy,100,5\n2,20,A,trade,,100,2\n")
    assert adapters.for_path(path).name == "normalized_csv" and adapters.for_path("x_message.csv").name == "messages"
    seen = adapters.probe(spark, "normalized_csv", path)
    assert (seen["rows"], seen["symbols"], seen["first_ns"], seen["last_ns"], seen["kinds"], seen["without_side"]) == (2, 1, 10, 20, ["ADD", "TRADE"], 1)
    with pytest.raises(KeyError):
        adapters.get("none")
    with pytest.raises(ValueError):
        adapters.register(adapters.get("messages"))
    with pytest.raises(KeyError):
        adapters.for_path("x.bin")


def test_command_line(spark, sf, capsys):
    assert cli.main(["version"]) == 0 and cli.main(["adapters"]) == 0 and cli.main(["queries"]) == 0
    assert cli.main(["run", "no_such_query", sf]) == 2
    assert "normalized_csv" in capsys.readouterr().out


def test_exact_queue():
    q = kernels.queue_place("EXACT", "BUY", 10, 100, ahead=[(1, 50), (2, 30)])
    assert q.trade(20, 1) == 0 and q.ahead == 60
    assert q.trade(10, 99) == 0 and q.ahead == 60  # behind us
    q.cancelled(30, 2)
    assert q.ahead == 30 and q.trade(40) == 10 and q.remaining == 90
    assert q.trade(500, 7) == 90 and q.remaining == 0
    with pytest.raises(PermissionError):
        q.cancelled(1, None)
    with pytest.raises(PermissionError):
        kernels.queue_place("EXACT", "BUY", 10, 100)
    with pytest.raises(ValueError):
        kernels.queue_place("GUESS", "BUY", 10, 100)


def test_neutral_place_against_a_plain_loop():
    draw = random.Random(2)
    for _ in range(200):
        place, ahead, left, filled = kernels.QueuePlace("BUY", 1, 40, 90), 90, 40, 0
        for _ in range(12):
            qty, level = draw.randrange(1, 40), draw.randrange(0, 150)
            if draw.random() < 0.5:
                filled += place.trade(qty)
                over = max(0, qty - ahead)
                ahead, left = max(0, ahead - qty), left - min(left, over)
            else:
                place.cancelled(qty, level, "neutral")
                ahead -= min(ahead, int(qty * min(max(ahead / level, 0), 1)) if level else 0)
            assert (place.ahead, place.remaining, filled) == (ahead, left, 40 - left)


def test_book_orders():
    b = kernels.OrderBook()
    for k in (1, 2, 3):
        b.add(k, "BUY", 10, 5)
    b.modify(1, 4)
    assert b.ahead(2) == 4
    b.modify(1, 3, keep=False)
    assert b.ahead(2) == 0 and b.ahead(1) == 10
    for bad in (lambda: b.modify(9, 1), lambda: b.replace(9, 1, 1), lambda: b.cancel(9), lambda: b.add(1, "BUY", 1, 1)):
        with pytest.raises(kernels.BookError):
            bad()


def test_simulations(spark, sf):
    exact = simulation.queue_exact(spark, sf).collect()
    assert exact and all(r.filled + r.remaining == 500 for r in exact)
    runs = simulation.simulate_runs(spark, sf).collect()
    assert len(runs) == 80 and {(r.policy, r.style) for r in runs} == {(p, s) for p in ("twap", "vwap", "pov", "is") for s in ("passive", "aggressive")}


def test_bootstrap():
    assert experiments.bootstrap([3.0], 5, 10, 0.95, "x") == (3.0, 3.0, 3.0)
    values = [float(k % 7) for k in range(40)]
    for block in (1, 5, 100):
        mean, low, high = experiments.bootstrap(values, block, 300, 0.95, "x")
        assert low <= mean == sum(values) / 40 <= high
    assert experiments.bootstrap(values, 5, 300, 0.95, "x") == experiments.bootstrap(values, 5, 300, 0.95, "x")


def test_book_limits_and_hooks():
    seen = []
    b = kernels.book_for("L2_MBP", strict=False, max_levels=2, band=(1, 100), hook=lambda code, text: seen.append(code))
    b.apply("ADD", "BUY", 10, 5)
    b.apply("ADD", "SELL", 10, 5)  # locked: a real state
    b.apply("ADD", "SELL", 9, 5)  # crossed
    b.apply("ADD", "BUY", 500, 5)  # outside the band
    b.apply("TRADE", "BUY", 9, 7)  # of 5
    assert seen[0] == "locked" and "crossed" in seen and "band" in seen and "depth" in seen
    assert (b.traded, b.trades) == (5, 1) and 500 not in b.sides["BUY"]
    b.apply("ADD", "BUY", 8, 1)
    with pytest.raises(kernels.BookError):
        b.apply("ADD", "BUY", 7, 1)
    strict = kernels.PriceBook(strict_locked=True)
    strict.apply("ADD", "BUY", 10, 5)
    with pytest.raises(kernels.BookError):
        strict.apply("ADD", "SELL", 10, 5)
    assert isinstance(kernels.book_for("L3_MBO"), kernels.OrderBook)
    with pytest.raises(PermissionError):
        kernels.book_for("L1")
