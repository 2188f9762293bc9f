import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.operators import kernels
from tapeworks.sources import readers as R
from tapeworks.streaming import flows


def test_normalized_csv_and_parquet(spark, tmp_path):
    (tmp_path / "e.csv").write_text("sequence_id,exchange_timestamp_ns,symbol,event_type,side,price_ticks,quantity_base,order_id\n1,5,T,add,buy,9999,300,\n2,6,T,trade,None,9999,10,7\n")
    rows = R.normalized_csv(spark, str(tmp_path / "e.csv")).orderBy("sequence_id").collect()
    assert [(r.event_type, r.side, r.order_id, r.flags, r.source) for r in rows] == [("ADD", "BUY", None, 0, "normalized"), ("TRADE", None, 7, 0, "normalized")]
    R.normalized_csv(spark, str(tmp_path / "e.csv")).write.parquet(str(tmp_path / "p"))
    again = R.normalized_parquet(spark, str(tmp_path / "p"))
    assert [f.dataType for f in again.schema] == [f.dataType for f in R.EVENT] and again.count() == 2


def test_messages(spark, tmp_path):
    (tmp_path / "m.csv").write_text("34200.000000001,1,11,100,1000000,1\n34200.5,5,11,10,1000100,-1\n34201,7,0,0,-1,-1\n")
    rows = R.messages_csv(spark, str(tmp_path / "m.csv"), "T", 10).orderBy("sequence_id").collect()
    assert [(r.event_type, r.side, r.price_ticks, r.flags) for r in rows] == [("ADD", "BUY", 10000, 0), ("TRADE", "SELL", 10001, 18), ("HALT", "SELL", 0, 0)]
    assert rows[0].exchange_timestamp_ns == 34_200_000_000_011
    (tmp_path / "x.csv").write_text("1,6,1,1,1,1\n")
    with pytest.raises(Exception, match="unknown message type"):
        R.messages_csv(spark, str(tmp_path / "x.csv"), "T", 0).collect()


def capture(**more):
    return {"symbol": "T", "tick_size": "0.1", "quantity_step": "0.01", "snapshot": {"lastUpdateId": 10, "bids": [["1.1", "2.00"]], "asks": [["1.3", "1.50"]]}, "depth_events": [{"E": 1, "U": 9, "u": 10, "b": [["9.9", "1"]], "a": []}, {"E": 2, "U": 11, "u": 12, "b": [["1.2", "0.05"]], "a": []}]} | more


def test_depth_capture(spark, tmp_path):
    def read(doc):
        (tmp_path / "c.json").write_text(json.dumps(doc))
        return sorted((r.u, r.side, r.price_ticks, r.quantity_base) for r in R.depth_capture(spark, str(tmp_path / "c.json")).collect())

    assert read(capture()) == [(10, "BUY", 11, 200), (10, "SELL", 13, 150), (12, "BUY", 12, 5)]
    with pytest.raises(Exception, match="sequence gap"):
        read(capture(depth_events=[{"E": 2, "U": 13, "u": 14, "b": [], "a": []}]))
    with pytest.raises(Exception, match="fractional"):
        read(capture(quantity_step="0.04"))


def test_synthetic_is_valid_and_repeatable(spark):
    a = R.synthetic(spark, [1, 2, 3], 500).collect()
    assert sorted(a) == sorted(R.synthetic(spark, [3, 2, 1], 500).collect())
    for seed in (1, 2, 3):
        book = kernels.PriceBook()
        for r in sorted((r for r in a if r.seed == seed), key=lambda r: r.sequence_id):
            try:
                book.apply(r.event_type, r.side, r.price_ticks, r.quantity_base)
            except kernels.BookError as e:
                assert "crossed" in str(e)


def test_store(spark, tmp_path):
    schema = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("x", T.LongType()), T.StructField("note", T.StringType())])
    s = R.Store(spark, str(tmp_path / "s"), {"runs": schema, "other": schema}, {"runs": ["run_id"]})
    assert s.read("runs").count() == 0
    s.write("runs", spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, x long"))
    s.write("runs", spark.createDataFrame([("b", 5)], "run_id string, x long"))
    assert sorted((r.run_id, r.x, r.note) for r in s.read("runs").collect()) == [("a", 1, None), ("b", 5, None)]
    assert s.status() == {"runs": True, "other": False}
    s.views()
    assert spark.sql("SELECT sum(x) FROM runs").first()[0] == 6 and spark.sql("SELECT * FROM other").count() == 0


def test_require():
    needs = {"top": "L1", "depth": "L2_MBP", "queue": "L3_MBO"}
    R.require("L3_MBO", "depth", needs)
    for tier, what, exact in (("L1", "depth", frozenset()), ("L3_MBO", "depth", frozenset({"depth"}))):
        with pytest.raises(PermissionError):
            R.require(tier, what, needs, exact)
    with pytest.raises(KeyError):
        R.require("L1", "nothing", needs)


def test_streams_equal_batch(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").alias("seq"), (F.col("id") % 2).alias("symbol"), F.timestamp_seconds(1_000_000 + F.col("id") * 20).alias("ts"), (100 + F.col("id")).alias("price"), (1 + F.col("id") % 3).alias("qty"))
    rows.unionByName(rows.where("seq % 10 = 0")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def run(frame, name):
        q = frame.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()))

    assert len(run(flows.deduplicated(stream, ["seq"]), "once")) == 60
    late = "0 seconds"
    batch = sorted(map(tuple, flows.bucket_volumes(spark.read.parquet(str(tmp_path / "in")), "5 minutes").collect()))
    got = run(flows.bucket_volumes(stream, "5 minutes", late=late), "buckets")
    assert got and set(got) <= set(batch) and len(got) >= len(batch) - 2
    assert flows.sessions(rows, "1 minute", "symbol").count() == 2
