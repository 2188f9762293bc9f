"""Further columns whose names the operators use themselves stay as they are; ids far from all others."""

import random

import pytest
from pyspark.sql import functions as F

from tapeworks.llm import decontaminate, fingerprints, mixing, ngram_join, repeats

NAMES = ["__places", "__doc", "__count", "__steps", "__pool", "__key", "__n", "__winner", "__first", "__r", "__hit_spans", "__hit_items", "__bucket", "__more", "__to", "own0"]


@pytest.fixture
def clashing(frame):
    passage = " ".join(f"w{k}" for k in range(70))
    rows = [(1, passage), (2, "x " + passage), (3, passage), (4, None), (5, ""), (6, "other words of a text that is on its own here")]
    return frame(rows).select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id")).alias(n) for n in NAMES])


def kept(out, key="doc_id"):
    rows = out.collect()
    assert all(r[n] == f"{n}:{r[key]}" for r in rows for n in NAMES)
    return [r[key] for r in rows]


def test_names(spark, clashing):
    bench = spark.createDataFrame([("b", "other words of a text that is on its own here")], "item_id string, text string")
    assert sorted(kept(repeats.repeats(clashing))) == [1, 2, 3, 4, 5, 6]
    assert sorted(kept(ngram_join.keep_one(clashing))) == [1, 4, 5, 6]
    assert sorted(kept(decontaminate.decontaminate(clashing, bench, "documents"))) == [1, 2, 3, 4, 5]
    assert set(kept(mixing.mix(clashing, {"s0": 1.0}, 1.0))) <= {1, 2, 3, 4, 5, 6}
    assert sorted(kept(fingerprints.with_next(clashing, ["text"]))) == [1, 2, 3, 4, 5, 6]


def test_next_with_ids_far_away(spark, frame):
    draw = random.Random(4)
    ids = [10**15, -(10**14), *draw.sample(range(5000), 1500)]
    found = {r.doc_id: r.next_text for r in fingerprints.with_next(frame([(i, f"t{i}") for i in ids]).repartition(5), ["text"]).collect()}
    down = sorted(ids, reverse=True)
    assert found == {a: f"t{b}" for a, b in zip(down, [*down[1:], down[0]])}


def test_a_small_source_with_a_large_weight(spark, frame):
    docs = frame([(k, "abc") for k in range(3000)]).withColumn("source", F.when(F.col("doc_id") == 0, "rare").otherwise("rest"))
    out = mixing.mix(docs, {"rare": 1.0}, 1.0, unit="rows")
    n = out.where("source = 'rare'").count()
    assert 1200 < n < 1800  # half of 3,000 rows by one document's copies
