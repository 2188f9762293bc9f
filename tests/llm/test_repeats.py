import hashlib
import random
import re

import pytest

from tapeworks.llm import repeats as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=50):
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    least = {}
    for d, w in split:
        if d is not None:
            for k in range(len(w) - size + 1):
                key = tuple(w[k : k + size])
                least[key] = min(d, least.get(key, d))
    out = []
    for d, w in split:
        gone = set()
        for k in range(len(w) - size + 1):
            if d is not None and least[tuple(w[k : k + size])] < d:
                gone |= set(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def planted(seed=5):
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefghijklmnop") + str(draw.randrange(40))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 200)]
    rows = []
    for k in range(60):
        text = [word() for _ in range(draw.randrange(80))]
        for _ in range(draw.randrange(3)):
            p = draw.choice(passages)
            a = draw.randrange(len(p) - 40)
            text += p[a:] + [word() for _ in range(draw.randrange(70))]
        rows.append((k, draw.choice([" ", "\n", "  "]).join(text)))
    same = " ".join("same" for _ in range(130))
    return rows + [(60, same), (61, same), (61, rows[3][1]), (61, rows[3][1]), (62, None), (63, ""), (None, rows[3][1]), (64, rows[3][1] + "\t" + same), (-7, rows[5][1])]


def test_cover():
    assert R.covers(R.PERIOD, R.COVER)
    assert not R.covers(7, (1, 2))


@pytest.mark.parametrize("bits", [R.BLOOM_BITS, 6])
def test_planted(spark, frame, bits):
    rows = planted()
    docs = frame(rows).selectExpr("*", "'x' AS n_words").repartition(4)
    found = R.repeats(docs, bloom_bits=bits).select("doc_id", "n_words", "n_removed", "kept_sha256")
    key = lambda r: (r[0] is None, r)
    want = brute(rows)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    assert sum(r[2] for r in want) > 500
    text = R.repeats(docs, bloom_bits=bits, action="text")
    assert text.columns == docs.columns
    shas = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in text.collect())
    assert shas == sorted(r[3] for r in want)


def test_query(spark, sf, documents):
    found = R.op2_repeats(spark, sf)
    want = brute([(r.doc_id, r.text) for r in documents.collect()])
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert any(r[2] for r in want)


def test_empty_and_wrong(spark, frame):
    assert R.repeats(frame([])).count() == 0
    with pytest.raises(ValueError):
        R.repeats(frame([]), size=20)
    with pytest.raises(ValueError):
        R.repeats(frame([]), action="x")
