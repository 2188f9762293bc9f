import hashlib
import math

import duckdb
import pytest

from tapeworks.llm import mixing as M


def count(doc_id, rate, seed=M.SEED):
    u = int(hashlib.md5(f"{seed}:{doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    k, cdf = 0, math.exp(-rate)
    while cdf <= u and rate > 0:
        k += 1
        cdf += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
    return k


def test_poisson_cdf():
    assert M.poisson_cdf(0) == []
    steps = M.poisson_cdf(2.5)
    assert steps[0] == pytest.approx(math.exp(-2.5)) and steps == sorted(steps) and steps[-1] < 1
    assert len(M.poisson_cdf(900.0)) > 900


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    found = M.op1_mixing(spark, sf)
    order = ["doc_id", "text", "lang", "source", "n_chars", "copy", "shuffle_key"]
    assert found.columns == order
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(M.OP1_SQL).fetchall())


def test_counts_follow_weights(spark):
    docs = spark.range(30000).selectExpr("id AS doc_id", "repeat('x', 5) AS text", "IF(id % 3 = 0, 'hot', CAST(id % 7 AS string)) AS source")
    weights = {"hot": 0.1, "1": 0.5}
    found = M.mix(docs, weights, other=0.4)
    rates = M.rates(docs, weights, 0.4, None, "source", "text", "chars")
    assert set(rates) == {"hot", "1", None}
    n = {r.source: r["count"] for r in found.groupBy("source").count().collect()}
    assert n["hot"] == pytest.approx(3000, rel=0.1) and n["1"] == pytest.approx(15000, rel=0.05)
    some = {(r.doc_id, r.copy) for r in found.where("source = '1'").collect()}
    ids = [r.doc_id for r in docs.where("source = '1'").collect()]
    assert some == {(i, c) for i in ids for c in range(count(i, rates["1"]))}


def test_nulls_repeats_clashes_and_empty(spark, frame):
    docs = frame([(1, "aa"), (1, "aa"), (None, "b"), (2, None), (3, "")]).selectExpr("*", "'mine' AS copy")
    found = M.mix(docs, {"s1": 1.0}, other=1.0, total=1000)
    rows = found.collect()
    n = {}
    for r in rows:
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert n[1] % 2 == 0 and n[1] > 100
    assert {r.copy for r in rows if r.doc_id == 1} == set(range(n[1] // 2))
    assert M.mix(frame([]), {"s1": 1.0}).count() == 0
    assert M.mix(docs, {"s1": 1.0}, unit="rows").where("source <> 's1'").count() == 0
    for wrong in ({"weights": {"a": -1.0}}, {"weights": {}, "other": 0.0}, {"weights": {"a": 1.0}, "unit": "bytes"}):
        with pytest.raises(ValueError):
            M.mix(docs, **wrong)


def test_no_python_on_executors(documents):
    """Workers that only read the steps would keep their memory through the pipeline's next stage."""
    plan = M.mix(documents, M.WEIGHTS, M.OTHER)._jdf.queryExecution()
    leaves = plan.optimizedPlan().collectLeaves()
    logical = [leaves.apply(k) for k in range(leaves.size())]
    rdds = [x.rdd().toDebugString() for x in logical if x.nodeName().startswith("LogicalRDD")]
    assert not any("PythonRDD" in r for r in rdds)
