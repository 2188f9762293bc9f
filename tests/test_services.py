"""Configuration, reports, streaming state, and that no window looks ahead."""

import json

import pytest
from pyspark.sql import functions as F

from tapeworks.plans import labels, series
from tapeworks.sources import config, reports
from tapeworks.sources import market as M
from tapeworks.streaming import state


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"fees": {"taker": 3}, "seeds": [1, 2]}))
    c = config.load(str(path))
    assert config.require(c, "fees.taker", int, 0) == 3
    for name, kind, least in (("fees.maker", int, None), ("fees.taker", str, None), ("fees.taker", int, 5)):
        with pytest.raises(config.ConfigError):
            config.require(c, name, kind, least)
    assert config.fingerprint({"a": 1, "b": 2}) == config.fingerprint({"b": 2, "a": 1}) != config.fingerprint({"a": 2})
    path.write_text("[1]")
    with pytest.raises(config.ConfigError):
        config.load(str(path))
    assert config.environment(folder=str(tmp_path))["git_commit"] is None and config.environment()["python"]


def test_report(spark, tmp_path):
    path = reports.write(str(tmp_path / "r.html"), "A & B", {"numbers <x>": spark.range(5)}, {"rows": 5}, rows=3)
    text = open(path).read()
    assert "A &amp; B" in text and "numbers &lt;x&gt;" in text and text.count("<td>") == 3 and "More than 3" in text


def stream(spark, rows, path):
    rows.coalesce(1).write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def test_trailing_state(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 2).alias("k"), (F.col("id") * 1_000_000_000).alias("t"), F.col("id").alias("seq"), (F.col("id") % 5).alias("qty"), F.timestamp_seconds("id").alias("ts"))
    q = state.trailing_sums(stream(spark, rows, str(tmp_path / "in")), "k", 6_000_000_000).writeStream.outputMode("append").format("memory").queryName("trail").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.seq: r.trailing for r in spark.table("trail").collect()}
    assert got == {i: sum(j % 5 for j in range(i + 1) if j % 2 == i % 2 and j >= i - 6) for i in range(40)}


def test_timers_and_observers(spark, tmp_path):
    for k, (symbol, at) in enumerate([("a", 0), ("a", 10), ("b", 12), ("c", 500), ("c", 900)]):
        spark.createDataFrame([(symbol, at)], "s string, x long").select("s", F.timestamp_seconds(F.col("x") + 1000).alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("s string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    state.observed(state.due_actions(source, "s", 60_000), lambda batch, k: seen.extend(batch.collect()), "due", str(tmp_path / "c"))
    assert {(r.s, r.n, r.last_ms) for r in seen} == {("a", 2, 1_010_000), ("b", 1, 1_012_000)}


@pytest.mark.parametrize("query", [series.rolling_ofi, series.rolling_flow, series.realized_vol, labels.market_state])
def test_prefix_invariance(spark, sf, tmp_path, query):
    """Cutting the stream off later must not change what was known before."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    cut = events.agg(F.expr("percentile_approx(ts, 0.6)")).first()[0]
    events.where(F.col("ts") <= cut).write.parquet(f"{tmp_path}/events.parquet")
    early, late = (sorted(map(tuple, query(spark, d).collect()), key=str) for d in (str(tmp_path), sf))
    shared = {r[1] for r in early}
    # a coarse clock shares times between both sides of the cut; only whole ones compare
    known = {r.seq for r in M.events(spark, sf).where(F.col("t") < F.unix_micros(F.lit(cut)) * 1000 - 4 * series.HOUR).select("seq").collect()}
    assert known & shared and [r for r in early if r[1] in known] == [r for r in late if r[1] in known]
