import random
import zlib

import pytest

from tapeworks.llm import toxicity as X


def texts(n, seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice(["th", "on", "er", "ly", "an", "re"]) for _ in range(draw.randrange(1, 4)))
    out = []
    for k in range(n):
        words = [word() for _ in range(draw.randrange(20, 200))]
        bad = k % 4 == 0
        for _ in range(3 * bad):
            words.insert(draw.randrange(len(words)), draw.choice(["Grumblefoot,", "snarkwort!", "zibbledunk"]))
        out.append((" ".join(words), int(bad)))
    return out


@pytest.fixture(scope="module")
def model():
    return X.learn(texts(240, 1))


def test_separates_unseen_texts(model):
    import pyarrow as pa

    rows = texts(200, 2)
    s = X.Scorer(model).scores(pa.array([t for t, _ in rows]))
    assert all((v >= X.PREDICT_AT) == bool(y) for v, (_, y) in zip(s, rows))


def test_without_two_classes():
    assert X.learn([]).base == 0.0 and X.learn([("a b", 1)]).base == 1.0
    few = X.learn([("a b", 1), (None, 0)])
    import pyarrow as pa

    assert len(X.Scorer(few).scores(pa.array(["x", None, ""]))) == 3


def test_rows(spark, frame, model):
    docs = frame([(1, "thon snarkwort! er " * 5), (1, "thon snarkwort! er " * 5), (2, None), (3, ""), (None, "th " * 50000 + "zibbledunk")]).selectExpr("*", "'x' AS score")
    rows = X.score(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[1]) == 1 and by[2] == by[3] and max(by[1]) > 0.7
    assert X.score(frame([]), model).count() == 0


def test_fit_takes_only_known_labels(spark, frame):
    rows = texts(60, 3)
    docs = frame([t for t, _ in rows])
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)] + [(None, 1), (5, None), (6, 7), (999, 1)], "doc_id long, toxic int")
    assert X.fit(docs, labels) == X.fit(docs.repartition(3), labels.repartition(2))
    assert X.fit(docs, labels, rows=5).base == 0.5
    assert X.fit(docs, labels.limit(0)).base == 0.0


def test_query(spark, sf, documents):
    rows = X.op5_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents.collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in X.op5_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    bad = [r.predicted for r in rows if labels[r.doc_id] == 1]
    good = [r.predicted for r in rows if labels[r.doc_id] == 0]
    assert sum(bad) >= 0.7 * len(bad) and sum(good) <= 0.02 * len(good)
