import random
import re

import pytest

from tapeworks.llm import ngram_join as J
from tapeworks.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 90 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for k, (d, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if root(m) == root(k) and rows[m][0] is not None]
        out.append((d, len(sets[k]), min(ids) if sets[k] and ids else d))
    return out


def near(seed, bases=6, copies=25):
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefghij") + str(draw.randrange(60))
    rows = []
    for b in range(bases):
        base = [word() for _ in range(draw.choice([8, 40, 120, 300]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(draw.randrange(6)):
                w[draw.randrange(len(w))] = word()
            if draw.random() < 0.2:
                w = w[: int(len(w) * draw.uniform(0.85, 1))]
            rows.append((len(rows) + 1, " ".join(w)))
    draw.shuffle(rows)
    return rows


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize("seed,rounds,bits", [(1, 2, 27), (2, 0, 27), (3, 1, 6)])
def test_planted(spark, frame, seed, rounds, bits):
    rows = near(seed)
    found = J.jaccard_components(frame(rows).repartition(3), rounds=rounds, bloom_bits=bits)
    want = brute(rows)
    assert order(map(tuple, found.collect())) == order(want)
    assert len({r[2] for r in want}) < len(rows)


def test_odd_rows(spark, frame):
    rows = [(5, "A b"), (4, "a  B"), (3, None), (2, ""), (1, " \t"), (9, "x"), (9, "X"), (None, "x y z w"), (8, "x y z w"), (7, "one two three four"), (7, "other words here now")]
    docs = frame(rows).selectExpr("*", "1 AS key", "2 AS label")
    assert order(map(tuple, J.jaccard_components(docs).collect())) == order(brute(rows))
    assert J.jaccard_components(frame([])).count() == 0


def test_query(spark, sf, documents):
    found = J.op4_ngram_join(spark, sf)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert order(map(tuple, found.collect())) == order(brute([(r.doc_id, r.text) for r in documents.collect()]))


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(30, 31), (40, 40), (50, 20)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(21)}, 50: 0, 30: 30, 31: 30}


def test_keep_one(spark, frame):
    rows = near(7, bases=3, copies=12) + [(None, "x y z w"), (900, "x y z w"), (901, "P q r s"), (901, "p Q r s"), (902, None), (902, None), (None, "only here now then")]
    kept = sorted(((r.doc_id, r.text) for r in J.keep_one(frame(rows)).collect()), key=str)
    comps = brute(rows)
    want, seen = [], set()
    for (d, t), (_, n, c) in sorted(zip(rows, comps), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[0][1] or "")):
        mark = (c, None) if n and c is not None else (None, t)
        if n == 0 or mark not in seen:
            want.append((d, t))
        if n:
            seen.add(mark)
    assert kept == sorted(want, key=str)


def test_null_ids_on_large_inputs(spark, frame):
    rows = near(11, bases=5, copies=5)
    rows = [(None if k % 2 else d, t) for k, (d, t) in enumerate(rows)]
    found = J.jaccard_components(frame(rows).repartition(3), bloom_bits=5)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("rounds", [0, 1])
def test_hot_tokens_are_split(spark, frame, rounds):
    rows = near(21 + rounds, bases=4, copies=20)
    found = J.jaccard_components(frame(rows).repartition(3), rounds=rounds, hot=1)
    assert order(map(tuple, found.collect())) == order(brute(rows))


def test_words_of_balanced_letters(spark, frame):
    """Words that polynomial hashes of any base take for equal."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"x {word} y"), (2, f"x {other} y"), (3, f"x {word} y")]
    assert order(map(tuple, J.jaccard_components(frame(rows)).collect())) == order(brute(rows))
