"""Windows of every ADD, against brute force."""

import pytest

from tapeworks.plans import series
from tapeworks.sources import market as M


@pytest.fixture(scope="module")
def rows(spark, sf):
    events = [r.asDict() for r in M.events(spark, sf).collect()]
    mids = sorted((r["symbol"], r["t"], r["seq"], r["mid2"]) for r in M.quotes(spark, sf).where("mid2 IS NOT NULL").collect())
    return events, mids, [e for e in events if e["kind"] == "ADD"]


def test_vwap_of_every_add(spark, sf, rows):
    events, _, adds = rows
    want = {}
    for a in adds:
        hit = [e for e in events if e["symbol"] == a["symbol"] and e["kind"] == "TRADE" and e["price"] > 0 and e["qty"] > 0 and a["t"] <= e["t"] <= a["t"] + series.DAY]
        if hit:
            want[a["symbol"], a["seq"]] = len(hit), sum(e["qty"] for e in hit), sum(e["price"] * e["qty"] for e in hit) / sum(e["qty"] for e in hit)
    found = {(r.symbol, r.run): r for r in series.interval_vwap(spark, sf).collect()}
    assert found.keys() == want.keys() and any(k[1] % 5 for k in want)
    for k, (n, volume, vwap) in want.items():
        assert (found[k].n_prints, found[k].volume) == (n, volume) and found[k].vwap == pytest.approx(vwap * 1e6, abs=1)


def test_mids_of_every_add(spark, sf, rows):
    _, mids, adds = rows
    want = {}
    for a in adds:
        hit = [(t, seq, m) for s, t, seq, m in mids if s == a["symbol"] and a["t"] <= t <= a["t"] + series.DAY]
        if hit:
            want[a["symbol"], a["seq"]] = hit
    ends = {(r.symbol, r.run): r for r in series.arrival_terminal_mid(spark, sf).collect()}
    twap = {(r.symbol, r.run): r for r in series.interval_twap(spark, sf).collect()}
    assert ends.keys() == twap.keys() == want.keys() and any(k[1] % 5 for k in want)
    for k, hit in want.items():
        assert (ends[k].arrival2, ends[k].terminal2, ends[k].n_mids) == (hit[0][2], hit[-1][2], len(hit)) == (hit[0][2], hit[-1][2], twap[k].n_mids)
        assert ends[k].mean_mid == pytest.approx(sum(m for *_, m in hit) / len(hit) / 2 * 1e6, abs=1)
        width = hit[-1][0] - hit[0][0]
        area = sum((x[2] + y[2]) * (y[0] - x[0]) for x, y in zip(hit, hit[1:]))
        assert twap[k].twap == (None if not width else pytest.approx(area / width / 4 * 1e6, abs=1))
