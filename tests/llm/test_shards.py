import pytest
from pyspark.sql import functions as F

from tapeworks.llm import _tables, shards


def rows(frame):
    return sorted(map(repr, map(tuple, frame.collect())))


def store(spark, docs, **more):
    return shards.ShardStore(spark, _tables.fresh_path(spark, "shards"), docs.schema, **more)


def test_compaction_keeps_every_row(spark, documents):
    s = store(spark, documents, fanout=3, target_bytes=100_000)
    for k in range(7):
        s.append(documents.where(F.pmod("doc_id", F.lit(7)) == k))
    before = s.runs()
    assert len(before) == 7 and sum(r.rows for r in before) == documents.count()
    version = s.compact()
    assert rows(s.read(8)) == rows(documents)
    assert version > 7 and len(s.runs()) < 7 and not s.plan(s.runs())
    assert rows(s.read()) == rows(documents)
    assert rows(s.read(7)) == rows(documents)
    s.vacuum()
    assert rows(s.read()) == rows(documents)
    biggest = max(s.runs(), key=lambda r: r.bytes)
    assert biggest.files >= 1 and biggest.bytes / biggest.files < 250_000
    located = s.located()
    spans = located.groupBy("shard").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where(F.col("shard").startswith(biggest.name)).orderBy("a").collect()
    assert all(x.b <= y.a for x, y in zip(spans, spans[1:]))


def test_one_of_two_writers_fails(spark, documents):
    s = store(spark, documents)
    s.append(documents.limit(5))
    with pytest.raises(shards.ManifestConflict):
        s._commit(0, [])
    assert s.versions() == [1]


def test_odd_rows_and_empty(spark, frame):
    docs = frame([(1, "a"), (1, "a"), (None, None), (2, "")]).selectExpr("*", "'x' AS shard")
    s = store(spark, docs, fanout=2)
    s.append(docs.limit(0))
    assert s.runs() == [] and s.read().count() == 0 and s.located().count() == 0
    s.append(docs)
    s.append(docs)
    s.compact()
    assert rows(s.read()) == rows(docs.union(docs))
    assert len(s.runs()) == 1 and s.located().where("shard_bytes > 0").count() == 8
    with pytest.raises(ValueError):
        store(spark, docs, fanout=1)


def test_query(spark, sf, documents):
    found = shards.op9_shards(spark, sf)
    assert rows(found.select(documents.columns)) == rows(documents)
    assert found.where("manifest_version < 2 OR shard NOT LIKE 'm%'").count() == 0


def test_merges_until_nothing_is_left_to_plan(spark, documents):
    """What is planned is among the runs, merges into one that holds all its rows, and rows stay."""
    s = store(spark, documents, fanout=2, target_bytes=50_000)
    for k in range(4):
        s.append(documents.where(F.pmod("doc_id", F.lit(4)) == k))
    before = {r.name: r.rows for r in s.runs()}
    names = [getattr(r, "name", r) for r in s.plan(s.runs())]
    assert len(names) >= 2 and set(names) <= set(before)
    version = max(s.versions())
    s.compact()
    assert max(s.versions()) > version and not s.plan(s.runs())
    assert sum(before[n] for n in names) <= max(r.rows for r in s.runs())
    assert sum(r.rows for r in s.runs()) == documents.count() and rows(s.read()) == rows(documents)
