import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeworks.llm import _tables, token_store


@pytest.fixture(scope="module")
def encoder():
    return token_store.PieceEncoder(token_store.default_tokenizer())


def plain(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


ODD = ["", None, "a  b \n\n c", "it's  don't 'x y' 12ab.. <|endoftext|> z", " lead", "trail ", "\n", "\n\nq", "日本 語 テ", "a\tb c\x1c d", "x y z", "a.\n'b' c", "'", "' '", "é×÷ß ñ.ж"]


def test_pieces_give_the_tokenizer_s_ids(encoder):
    ids, counts = encoder.texts(pa.array(ODD))
    assert counts.tolist() == [len(plain(encoder, t)) for t in ODD]
    assert ids.tolist() == [i for t in ODD for i in plain(encoder, t)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abZ9 .,'\n\té日 -s", max_size=30), max_size=6))
def test_pieces_of_any_text(encoder, texts):
    ids, counts = encoder.texts(pa.array(texts, pa.string()))
    assert ids.tolist() == [i for t in texts for i in plain(encoder, t)]
    assert counts.tolist() == [len(plain(encoder, t)) for t in texts]


def many(n):
    """Texts of n distinct words, each after a line end, after a space, before a stop and alone."""
    words = ["".join("etaoinshrd"[int(c)] for c in str(k)) for k in range(n)]
    return [f"{w} {w}.{w}\n{w}" for w in words]


def test_ids_when_the_table_grows_and_begins_anew():
    encoder = token_store.PieceEncoder(token_store.default_tokenizer(), room=5_000)
    texts, sizes = many(60_000), set()
    for k in range(0, len(texts), 20_000):
        some = texts[k : k + 20_000] + texts[:50]
        ids, counts = encoder.texts(pa.array(some))
        want = [e.ids for e in encoder.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]
        sizes.add(len(encoder.slot_key))
    assert max(sizes) > 1 << 16


def test_apostrophes_hold_their_piece_together(encoder):
    texts = ["a b'c d'e' f g", "'a b c' d\n'e f", "12'b 'c'd' e-f 'g", "x 'y z' w"] * 3
    ids, counts = encoder.texts(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in plain(encoder, t)]


def test_memory_of_known_pieces():
    """The pieces of a task take little beside the tokenizer: an executor has several such tasks."""
    encoder = token_store.PieceEncoder(token_store.default_tokenizer())
    tracemalloc.start()
    encoder._reset()
    for k in range(0, 50_000, 5_000):
        encoder.texts(pa.array(many(50_000)[k : k + 5_000]))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 20e6


def test_tasks_of_a_worker_share_the_pieces():
    file = token_store.default_tokenizer()
    encoder = token_store._encoder(file)
    ids, _ = encoder.texts(pa.array(many(2_000)))
    known = encoder.known
    again, _ = token_store._encoder(file).texts(pa.array(many(2_000)))
    assert known == token_store._encoder(file).known and (ids == again).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    for n in (1, 7, 8, 1000):
        ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
        assert (token_store.from_planes(token_store.to_planes(ids, kind), n) == ids).all()


def test_planes_must_be_known():
    with pytest.raises(ValueError):
        token_store.to_planes(np.zeros(1, dtype=np.uint32), "nibble")


def test_crc_joined():
    a, b = b"some bytes", b"and others" * 50
    assert token_store.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert token_store.crc_joined(zlib.crc32(a), 0, 0) == zlib.crc32(a)


def test_crc_joined_of_many_lengths_is_cheap(monkeypatch):
    calls, times = [], token_store._times
    token_store.crc_joined(1, 0, (1 << 24) - 1)
    monkeypatch.setattr(token_store, "_times", lambda *a: calls.append(1) or times(*a))
    for n in range(1_000_000, 1_000_100):
        token_store.crc_joined(5, 0, 4 * n)
    assert len(calls) <= 100 * 24


def test_blocks_are_decoded_once(spark, documents):
    path = token_store.write_tokens(documents, _tables.fresh_path(spark, "t"))
    plan = token_store.digests(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def expected(encoder, rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*plain(encoder, text), 2], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("kind,block", [("byte", 64), ("bit", 50), ("byte", 1 << 16)])
def test_store_round_trip(spark, encoder, documents, kind, block):
    path = token_store.write_tokens(documents.repartition(5), _tables.fresh_path(spark, "t"), planes=kind, block=block)
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    assert sorted(map(tuple, token_store.digests(spark, path).collect())) == expected(encoder, rows)


def test_nulls_repeats_extra_columns_and_empty(spark, encoder, frame):
    docs = frame([(5, "b b"), (5, "a a"), (None, "n"), (2, None), (9, "")]).selectExpr("*", "1 AS part", "2 AS block")
    path = token_store.write_tokens(docs, _tables.fresh_path(spark, "t"), block=2)
    rows = [(None, "n"), (2, None), (5, "a a"), (5, "b b"), (9, "")]
    key = lambda r: r[1]
    assert sorted(map(tuple, token_store.digests(spark, path).collect()), key=key) == expected(encoder, rows)
    path = token_store.write_tokens(docs.limit(0), _tables.fresh_path(spark, "t"))
    assert token_store.digests(spark, path).count() == 0


def test_query(spark, sf, encoder, documents):
    found = token_store.op3_token_store(spark, sf)
    assert dict(found.dtypes) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    assert sorted(map(tuple, found.collect())) == expected(encoder, sorted((r.doc_id, r.text) for r in documents.collect()))
