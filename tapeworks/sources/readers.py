"""Readers and the store: normalised events, message files, depth captures, synthetic sessions."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("sequence_id", T.LongType()),
        T.StructField("exchange_timestamp_ns", T.LongType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("side", T.StringType()),
        T.StructField("price_ticks", T.LongType()),
        T.StructField("quantity_base", T.LongType()),
        T.StructField("order_id", T.LongType()),
        T.StructField("trade_id", T.LongType()),
        T.StructField("flags", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("receive_timestamp_ns", T.LongType()),
    ]
)
AGGRESSOR_BUY, AGGRESSOR_SELL, HIDDEN = 1, 2, 16


def _normal(frame: DataFrame) -> DataFrame:
    """Known columns with their types; text of nothing is null; enums in upper case."""
    have = set(frame.columns)
    empty = lambda c: F.when(~F.lower(F.trim(c)).isin("", "none", "null", "nan"), F.trim(c))
    out = []
    for f in EVENT:
        c = empty(F.col(f.name).cast("string")) if f.name in have else F.lit(None).cast("string")
        if f.name in ("event_type", "side"):
            c = F.upper(c)
        default = {"flags": F.lit(0).cast("long"), "source": F.lit("normalized")}.get(f.name)
        c = c.cast(f.dataType)
        out.append((F.coalesce(c, default) if default is not None else c).alias(f.name))
    return frame.select(out)


def normalized_parquet(spark: SparkSession, path: str) -> DataFrame:
    return _normal(spark.read.parquet(path))


def normalized_csv(spark: SparkSession, path: str) -> DataFrame:
    return _normal(spark.read.csv(path, header=True))


def messages_csv(spark: SparkSession, path: str, symbol: str, base_ns: int, tick: int = 100) -> DataFrame:
    """Headerless message files: seconds, type, order id, size, price, direction. Types 1 add, 2 and 3
    cancel, 4 and 5 (hidden) trade, 7 halt; others raise, and so do rows of another width. Files are
    numbered row by row, in one partition per file, since rows have no other order; a trade's id is
    its row's number."""
    columns = "sec decimal(20,9), type int, order_id long, size long, price long, direction int"
    raw = spark.read.schema(columns).option("mode", "FAILFAST").csv(path).withColumn("f", F.col("_metadata.file_path")).withColumn("at", F.monotonically_increasing_id())
    row = F.row_number().over(Window.partitionBy("f").orderBy("at")) - 1
    kind = (
        F.when(F.col("type") == 1, "ADD")
        .when(F.col("type").isin(2, 3), "CANCEL")
        .when(F.col("type").isin(4, 5), "TRADE")
        .when(F.col("type") == 7, "HALT")
        .otherwise(F.raise_error(F.concat(F.lit("unknown message type "), F.col("type").cast("string"))))
    )
    buy = F.col("direction") >= 0
    trade = F.col("type").isin(4, 5)
    flags = F.when(trade & buy, AGGRESSOR_BUY).when(trade, AGGRESSOR_SELL).otherwise(0) + F.when(F.col("type") == 5, HIDDEN).otherwise(0)
    return raw.select(
        row.cast("long").alias("sequence_id"),
        (F.lit(base_ns) + (F.col("sec") * F.lit(1_000_000_000)).cast("long")).alias("exchange_timestamp_ns"),
        F.lit(symbol).alias("symbol"),
        kind.alias("event_type"),
        F.when(buy, "BUY").otherwise("SELL").alias("side"),
        F.rint(F.col("price") / tick).cast("long").alias("price_ticks"),
        F.col("size").alias("quantity_base"),
        F.col("order_id"),
        F.when(trade, row.cast("long")).alias("trade_id"),
        flags.cast("long").alias("flags"),
        F.lit("messages").alias("source"),
        F.lit(None).cast("long").alias("receive_timestamp_ns"),
    )


def depth_capture(spark: SparkSession, path: str) -> DataFrame:
    """Absolute level sizes of a JSON capture (snapshot, then packets) as SNAPSHOT events in exact
    ticks and steps. Packets up to the snapshot's id go; a gap between packets raises."""
    # ids differ by case alone, so a packet is read as a map
    field = lambda name: F.get_json_object("value", f"$.{name}")
    pairs = lambda c: F.from_json(c, "array<array<string>>")
    raw = spark.read.text(path, wholetext=True).select(
        *[field(n).alias(n) for n in ("symbol", "tick_size", "quantity_step")],
        field("snapshot.lastUpdateId").cast("long").alias("last"),
        pairs(field("snapshot.bids")).alias("b"),
        pairs(field("snapshot.asks")).alias("a"),
        F.from_json(field("depth_events"), "array<map<string,string>>").alias("packets"),
    )
    names = ["symbol", "tick_size", "quantity_step", "last"]
    first = raw.select(*names, F.lit(0).cast("long").alias("ms"), F.col("last").alias("from_id"), F.col("last").alias("u"), "b", "a")
    later = raw.select(*names, F.explode("packets").alias("p")).select(
        *names, F.col("p")["E"].cast("long").alias("ms"), F.col("p")["U"].cast("long").alias("from_id"), F.col("p")["u"].cast("long").alias("u"), pairs(F.col("p")["b"]).alias("b"), pairs(F.col("p")["a"]).alias("a")
    )
    later = later.where("u > last")
    packets = first.unionByName(later)
    before = F.lag("u").over(Window.partitionBy("symbol").orderBy("u"))
    checked = packets.withColumn("gap", F.when(F.col("from_id") > before + 1, F.raise_error(F.lit("sequence gap"))))

    def sided(column, side):
        return F.transform(column, lambda x: F.struct(F.lit(side).alias("side"), x[0].cast("decimal(38,12)").alias("p"), x[1].cast("decimal(38,12)").alias("q")))

    both = F.concat(sided("b", "BUY"), sided("a", "SELL"))
    levels = checked.where("gap IS NULL").select("symbol", "tick_size", "quantity_step", "ms", "u", F.posexplode(both).alias("k", "x"))

    def exact(value, unit, name):
        parts = F.col(value) / F.col(unit).cast("decimal(20,12)")
        whole = F.rint(parts.cast("double")).cast("long")
        return F.when(whole * F.col(unit).cast("decimal(20,12)") == F.col(value), whole).otherwise(F.raise_error(F.lit(f"fractional {name}")))

    return levels.select("symbol", "u", "k", (F.col("ms") * 1_000_000).alias("exchange_timestamp_ns"), F.lit("SNAPSHOT").alias("event_type"), F.col("x.side").alias("side"), exact("x.p", "tick_size", "tick").alias("price_ticks"), exact("x.q", "quantity_step", "step").alias("quantity_base"))


def synthetic(spark: SparkSession, seeds: list[int], n_events: int, symbol: str = "SYN", depth: int = 5, size: int = 300, mid: int = 10_000) -> DataFrame:
    """Seeded sessions of valid events, one task a seed: a ladder, then 55 % adds, 24 % cancels and
    21 % trades at random gaps; removals never exceed what a level holds."""

    def run(batches):
        for batch in batches:
            for seed in batch.column(0).to_pylist():
                draw = random.Random(seed)
                book = {"BUY": {mid - 1 - k: size for k in range(depth)}, "SELL": {mid + 1 + k: size for k in range(depth)}}
                rows = [(seed, k - 2 * depth, 0, "ADD", s, p, q) for k, (s, p, q) in enumerate((s, p, q) for s in book for p, q in book[s].items())]
                t = 0
                for k in range(n_events):
                    t += draw.randint(10_000_000, 80_000_000)
                    x, side = draw.random(), draw.choice(("BUY", "SELL"))
                    level = book[side]
                    best = max(level) if side == "BUY" else min(level)
                    if x < 0.55 or sum(level.values()) < size:
                        price = best + (-draw.randrange(depth) if side == "BUY" else draw.randrange(depth))
                        qty = draw.randint(1, 220)
                        level[price] = level.get(price, 0) + qty
                        rows.append((seed, k, t, "ADD", side, price, qty))
                        continue
                    trade = x >= 0.79
                    price = best if trade else draw.choice(sorted(level))
                    qty = min(draw.randint(1, 220), level[price])
                    if qty == level[price] and len(level) == 1:
                        qty -= 1
                    if not qty:
                        continue
                    level[price] -= qty
                    if not level[price]:
                        del level[price]
                    rows.append((seed, k, t, "TRADE" if trade else "CANCEL", ("SELL" if side == "BUY" else "BUY") if trade else side, price, qty))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], type=kind) for c, kind in enumerate(kinds)], names=["seed", "sequence_id", "exchange_timestamp_ns", "event_type", "side", "price_ticks", "quantity_base"])

    schema = "seed long, sequence_id long, exchange_timestamp_ns long, event_type string, side string, price_ticks long, quantity_base long"
    one = spark.createDataFrame([(s,) for s in seeds], "seed long").repartition(max(1, len(seeds)), "seed")
    return one.mapInArrow(run, schema).withColumn("symbol", F.lit(symbol))


class Store:
    """Tables as partitioned Parquet under one folder, each with its schema; a rerun replaces its
    own partitions. Reading a table that was never written gives no rows."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, T.StructType], keys: dict[str, list[str]]) -> None:
        self.spark, self.root, self.schemas, self.keys = spark, root.rstrip("/"), schemas, keys

    def _there(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def write(self, name: str, rows: DataFrame) -> None:
        fields = self.schemas[name]
        typed = rows.select([F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
        writer = typed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(*self.keys[name]) if self.keys.get(name) else writer).parquet(f"{self.root}/{name}")

    def read(self, name: str) -> DataFrame:
        schema = self.schemas[name]
        if not self._there(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").select([f.name for f in schema])

    def status(self) -> dict[str, bool]:
        return {name: self._there(name) for name in self.schemas}

    def views(self) -> None:
        for name in self.schemas:
            self.read(name).createOrReplaceTempView(name)


#: Least tier that each capability needs; those in EXACT need that very tier.
TIERS = {"L1": 1, "L2_MBP": 2, "L3_MBO": 3}


def require(tier: str, capability: str, needs: dict[str, str], exact: frozenset[str] = frozenset()) -> None:
    """Refuse, while a plan is built, what the data can't support."""
    if capability not in needs:
        raise KeyError(f"unknown capability {capability!r}")
    need = needs[capability]
    if (tier != need) if capability in exact else TIERS[tier] < TIERS[need]:
        raise PermissionError(f"{capability} needs {need}, the data are {tier}")
