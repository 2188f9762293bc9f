import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tapeworks.llm import fingerprints as P

UNIT = re.compile(r"[^\x20\x09-\x0D]{1,16}")


def brute(spark, texts):
    """Chosen K-grams by definition, hashed by Spark's own function."""
    grams = {}
    units = [UNIT.findall(t) for t in texts]
    words = sorted({u for us in units for u in us})
    one = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in words] or [("",)], "w string").select("w", F.xxhash64("w")).collect()}
    pairs = sorted({(one[a], one[b]) for us in units for a, b in zip(us, us[1:])})
    two = {(r[0], r[1]): r[2] for r in spark.createDataFrame(pairs or [(0, 0)], "a long, b long").select("a", "b", F.xxhash64("a", "b")).collect()}
    for us in units:
        for k in range(len(us) - P.K + 1):
            g = tuple(two[one[us[k + j]], one[us[k + j + 1]]] for j in range(3))
            if min(g) in (g[0], g[2]):
                grams[g] = None
    keys = sorted(grams)
    hashed = {tuple(r)[:3]: r[3] for r in spark.createDataFrame(keys or [(0, 0, 0)], "a long, b long, c long").select("a", "b", "c", F.xxhash64("a", "b", "c")).collect()}
    out = []
    for us in units:
        found = set()
        for k in range(len(us) - P.K + 1):
            g = tuple(two[one[us[k + j]], one[us[k + j + 1]]] for j in range(3))
            if g in hashed and min(g) in (g[0], g[2]):
                found.add(hashed[g])
        out.append(found)
    return out


def test_sketch_by_definition(spark, documents):
    rows = documents.limit(60).select("text", P.sketch(F.col("text")).alias("s")).collect()
    for r, want in zip(rows, brute(spark, [r.text for r in rows])):
        if want:
            assert r.s == sorted(want)[: P.SKETCH]
        else:
            assert len(r.s) == 1


def expected_next(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    return [(a, b) for a, b in zip(order, order[1:] + order[:1])]


@pytest.mark.parametrize("bucket_rows", [1, 3, 256])
def test_next_and_edit(spark, documents, monkeypatch, bucket_rows):
    monkeypatch.setattr(P, "BUCKET_ROWS", bucket_rows)
    docs = documents.where("doc_id % 7 < 3 OR doc_id > 150").selectExpr("doc_id * doc_id - 50 AS doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in P.compare_edited(docs).collect()}
    assert len(got) == len(rows)
    for (d, t), (_, after) in expected_next(rows):
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == t:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint


def test_query(spark, sf, documents):
    found = P.op7_fingerprints(spark, sf)
    assert dict(found.dtypes)["n_chars"] == "bigint"
    rows = found.collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    long = [r for r in rows if r.n_chars > 1000]
    mean = lambda c: sum(r[c] for r in long) / len(long)
    assert mean("near_edited") > 0.4 and mean("near_next") < 0.1


def test_odd_texts(spark, frame):
    docs = frame([(1, None), (2, ""), (3, "one"), (4, "one"), (4, "one two"), (None, "x y z"), (5, "é" * 100)])
    rows = P.compare_edited(docs).collect()
    assert len(rows) == 7
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].fingerprint == by[2][0].fingerprint == "" and by[1][0].n_chars == 0
    assert by[2][0].near_next == 1.0 and by[3][0].near_next == 0.0
    assert by[3][0].fingerprint in [r.fingerprint for r in by[4]]
    assert P.compare_edited(frame([])).count() == 0
    alone = P.compare_edited(frame([(7, "a b c d e f")])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert P.anchors(docs.selectExpr("*", "1 AS place")).count() >= 1
    assert P.fingerprint(docs).where("fingerprint IS NULL").count() == 0


def test_likeness_by_brute_force(spark, documents):
    """near_edited and near_next against sketches made by definition."""
    docs = documents.where("doc_id % 9 = 2").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pairs = [(d, t, t[: len(t) - len(t) // 3] + after[: len(t) // 3], after) for (d, t), (_, after) in expected_next(rows)]
    sets = iter(brute(spark, [x for p in pairs for x in p[1:]]))
    least = lambda s: set(sorted(s)[: P.SKETCH])

    def like(a, b):
        whole = len(a) < P.SKETCH and len(b) < P.SKETCH
        union = sorted(a | b) if whole else sorted(a | b)[: P.SKETCH]
        return sum(x in a and x in b for x in union) / len(union)

    got = {r.doc_id: r for r in P.compare_edited(docs).collect()}
    checked = 0
    for d, _, _, _ in pairs:
        own, edited, after = (least(next(sets)) for _ in range(3))
        if own and edited and after:  # shorter texts are one hash of the whole
            assert got[d].near_edited == pytest.approx(like(own, edited), abs=1e-12) and got[d].near_next == pytest.approx(like(own, after), abs=1e-12)
            checked += 1
    assert checked > 10
