import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tapeworks.llm import ngram_lm as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def brute(train, rows):
    uni, bi = Counter(), Counter()
    for t in train:
        w = tokens(t)
        uni.update(w)
        bi.update(zip(["<s>", *w], w))
    n, v = sum(uni.values()), len(uni)
    after, follow = defaultdict(list), Counter(w for _, w in bi)
    for (c, _), k in bi.items():
        after[c].append(k)
    times = lambda values: [sum(x == k for x in values) for k in (1, 2, 3, 4)]
    high, low = L.discounts(times(bi.values())), L.discounts(times(follow.values()))
    d = lambda ds, k: 0 if k == 0 else ds[min(k, 3) - 1]
    left_low = sum(d(low, k) for k in follow.values()) / max(len(bi), 1)

    def lower(w):
        k = follow.get(w, 0)
        return (k - d(low, k)) / len(bi) + left_low / (v + 1) if bi else 1.0

    def prob(c, w):
        ks = after.get(c)
        if not ks:
            return lower(w)
        k = bi.get((c, w), 0)
        return (k - d(high, k)) / sum(ks) + sum(d(high, x) for x in ks) / sum(ks) * lower(w)

    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((uni.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        unknown = lambda x: x if x == "<s>" or x in uni else "<unk>"
        s = sum(math.log10(prob(unknown(c), x)) for c, x in zip(["<s>", *w], w))
        out.append((i, len(w), sum(x in uni for x in w), n, base, s))
    return out


def same(found, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    found, want = sorted(found, key=key), sorted(want, key=key)
    assert [f[:4] for f in found] == [w[:4] for w in want]
    for f, w in zip(found, want):
        assert f[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9)


COLUMNS = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_query_equals_brute_force(spark, sf, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    found = L.op10_ngram_lm(spark, sf)
    assert found.columns == ["doc_id", "held_out", *COLUMNS[1:]]
    got = found.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in got)
    same([tuple(r[c] for c in COLUMNS) for r in got], brute(train, rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark, frame):
    rows = [(1, "The cat the Cat"), (1, "the cat"), (None, None), (2, ""), (3, "a a a a " * 200), (4, "dog the cat sat")]
    docs = frame(rows).selectExpr("*", "'x' AS score")
    model = L.fit(docs)
    found = L.score(docs, model).select(COLUMNS).collect()
    same(map(tuple, found), brute([t for _, t in rows], rows))
    new = frame([(9, "unseen words the cat")])
    same(map(tuple, L.score(new, model).select(COLUMNS).collect()), brute([t for _, t in rows], [(9, "unseen words the cat")]))
    assert L.score(frame([]), model).count() == 0
    none = L.fit(frame([]))
    r = L.score(new, none).collect()[0]
    assert r.train_tokens == 0 and r.n_known == 0 and r.score == 0


def test_pack():
    draw = np.random.default_rng(0)
    for n in (0, 1, 1000):
        keys = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
        counts = draw.integers(1, 600, len(keys))
        k, c = L.unpack(L.pack(keys, counts))
        assert (k == keys).all() and (c == counts).all()


def test_discounts():
    assert L.discounts([0, 1, 1, 1]) == (0.5, 1.0, 1.5)
    d = L.discounts([100, 40, 20, 10])
    assert 0 < d[0] < 1 and d[0] < d[1] < 2 and d[1] < d[2] < 3


def test_folder_must_be_mounted():
    with pytest.raises(ValueError):
        L.mounted("hdfs://host/x")
