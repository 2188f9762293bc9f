import hashlib
import re

import pytest

from tapeworks.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, size=13, share=20):
    windows = []
    for i, t in items:
        w = words(t)
        if w:
            n = min(size, len(w))
            windows += [(str(i), tuple(w[k : k + n])) for k in range(len(w) - n + 1)]
    by = {}
    for i, w in windows:
        by.setdefault(w, set()).add(i)
    sizes = {len(w) for w in by}
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (owners := by.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= owners
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, bool(hit) and share * len(hit) >= len(w)))
    return out


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_query_equals_brute_force(spark, sf, documents):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = D.op6_decontaminate(spark, sf)
    assert found.columns == COLUMNS
    want = brute([(r.doc_id, r.text) for r in documents.collect()], bench)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert any(r[2] for r in want)


LONG = " ".join(f"w{k}" for k in range(30))
CASES = [
    ("Short! item", LONG),
    (LONG + " tail", "x SHORT, item y", None, "", LONG, LONG, "short", " ".join(["short item"] * 40), "é Ärger 東京 " + LONG),
]


@pytest.mark.parametrize("block_bytes", [D.BLOCK_BYTES, 20])
def test_cases(spark, frame, block_bytes):
    items = [(1, CASES[0][0]), (10, CASES[0][1]), (2, CASES[0][1]), (3, None), (4, " ,.")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(CASES[1]).selectExpr("*", "'x' AS n_hit")
    found = D.decontaminate(docs, bench, block_bytes=block_bytes).select(COLUMNS)
    assert sorted(map(tuple, found.collect())) == sorted(brute(list(enumerate(CASES[1])), items))
    kept = D.decontaminate(docs, bench, "documents", block_bytes=block_bytes)
    assert kept.columns == docs.columns
    bad = {r[0] for r in brute(list(enumerate(CASES[1])), items) if r[5]}
    assert {r.doc_id for r in kept.collect()} == set(range(len(CASES[1]))) - bad
    cut = {r.doc_id: r.text for r in D.decontaminate(docs, bench, "spans", block_bytes=block_bytes).collect()}
    assert cut[0] == " tail" and cut[1] == "x  y" and cut[2] is None and cut[3] == "" and cut[6] == "short" and cut[8] == "é Ärger 東京 "


def test_empty_tables(spark, frame):
    bench = spark.createDataFrame([], "item_id long, text string")
    rows = D.decontaminate(frame(["a b", None]), bench).select(COLUMNS).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, rows)) == [(0, 2, 0, 0, none, False), (1, 0, 0, 0, none, False)]
    assert D.decontaminate(frame([]), bench).count() == 0
    with pytest.raises(ValueError):
        D.decontaminate(frame([]), bench, "nothing")
