"""Nulls, empty and very long texts, repeated rows, empty tables and clashing names, stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

STAGES = dict(P.STAGES)
LONG = " ".join(f"w{k % 9973}x{k}" for k in range(150_000))


@pytest.fixture
def odd(frame):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (1, "another text of the same id here"), (2, None), (3, ""), (4, "\n \t"), (None, "a text without an id stands here"), (9, LONG)]
    return frame(rows).withColumn("__count", F.lit("c")).withColumn("predicted", F.lit("p")).withColumn("copy", F.lit(7))


def texts(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_empty(spark, sf, frame, name):
    out = STAGES[name](spark, frame([]), sf)
    assert out.count() == 0


def test_filters(spark, sf, odd):
    every = texts(odd)
    clean = STAGES["toxicity"](spark, odd, sf)
    assert clean.columns == odd.columns and texts(clean) == every
    once = STAGES["ngram_jaccard_join"](spark, odd, sf)
    assert once.columns == odd.columns and texts(once) == sorted({*map(tuple, every)}, key=str)
    kept = STAGES["decontamination"](spark, odd, sf)
    assert kept.columns == odd.columns and texts(kept) == every
    assert {(r["__count"], r.predicted, r.copy) for r in kept.collect()} == {("c", "p", 7)}


def test_mixing_and_tokens(spark, sf, odd):
    mixed = STAGES["mixing"](spark, odd.drop("copy"), sf)
    assert mixed.columns == odd.drop("copy").columns and {*texts(mixed)} <= {*texts(odd)}
    found = STAGES["token_output"](spark, odd, sf).collect()
    assert len(found) == 8
    assert sorted(r.n_tokens for r in found if r.doc_id in (2, 3)) == [1, 1]
    assert [r.start for r in found if r.doc_id is None] == [0]
    long = next(r for r in found if r.doc_id == 9)
    assert long.n_tokens > 150_000 and long.start == sum(r.n_tokens for r in found) - long.n_tokens
