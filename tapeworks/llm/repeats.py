"""Substring deduplication: word sequences that an earlier document has go from later ones.

A window is ``size`` consecutive words of one document. Each word covered by a window whose
word sequence also starts in a document with a smaller doc_id is removed; windows are judged
on the input. The search goes through anchors at the places of a difference cover: for every
two places i, j there is a shift s < PERIOD with i + s and j + s both in COVER modulo PERIOD,
so two equal windows share an equal anchor of ``size - PERIOD + 1`` words at the same shift.
Only windows around anchors that two rows share are hashed (96 bits) and grouped by their
least doc_id; no pairs are made. Of equal word sequences (128 bits) the row of the least doc_id
alone sends anchors and windows: the windows of the others all start in it too, so they lose
every word, if they have a window at all.

Which anchors are shared, which rows are the first of their word sequence and which have
removals goes to the tasks as Bloom filters of fixed size (``bloom_bits``) while they are sparse
enough for that; beyond it, shared anchors are joined back to their places, every row sends its
own windows and all texts are joined. Either way all windows of all texts are judged.

Null texts have no words. Rows with a null doc_id keep all words and remove none. Rows with
one doc_id don't remove from one another and each keep a row. Texts under ``size`` words
stay whole. Columns named like new ones are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.llm import _tables, _words

SIZE = 50
#: A perfect difference set modulo 31.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
BLOOM_BITS = 27
_PROBES = 4

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("removed_spans", T.ArrayType(T.IntegerType())),
    T.StructField("kept_sha256", T.StringType()),
]


def covers(period: int, cover: tuple[int, ...]) -> bool:
    """Whether every difference modulo ``period`` is one of two places of ``cover``."""
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _places(words: _words.Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors: first word, row, place in the row's text."""
    at = words.windows(length)
    doc = words.doc[at] if len(at) else at
    place = at - words.first[doc]
    in_cover = np.zeros(PERIOD, dtype=bool)
    in_cover[list(COVER)] = True
    mine = in_cover[place % PERIOD]
    return at[mine], doc[mine], place[mine]


def _row_keys(words: _words.Words) -> np.ndarray:
    """31 bits of each text's words, shifted left by 32: tells rows of one doc_id apart."""
    keys = words.window_hash(words.first[:-1], words.counts) >> np.uint64(33)
    return keys.astype(np.int64) << 32


def _slots(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    step = _words.mix(hashes) | np.uint64(1)
    return [(hashes + np.uint64(k) * step) >> np.uint64(64 - bits) for k in range(_PROBES)]


def sized(n: int, most: int) -> int:
    """Bits (as a power of two) of a filter of n things: 16 each or more, as far as ``most`` goes."""
    return min(most, max(10, (16 * n).bit_length()))


def _in_bloom(hashes: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    out = np.ones(len(hashes), dtype=bool)
    for slot in _slots(hashes, bits):
        out &= (words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
    return out


def _bloom(shared: DataFrame, bits: int, hashes=lambda batch: batch.column(0).to_numpy().view(np.uint64)) -> np.ndarray:
    """The filter of all shared anchors: 2^bits bits, or-ed by word in the cluster. ``hashes`` has those
    of a batch; found here, they need no second Python worker in the task."""
    schema = "word long, bit long"

    def run(batches):
        for batch in batches:
            slots = np.unique(np.concatenate(_slots(hashes(batch), bits)))
            word = (slots >> np.uint64(6)).astype(np.int64)
            first = np.flatnonzero(np.append(True, np.diff(word) > 0)) if len(word) else np.zeros(0, dtype=np.int64)
            ored = np.bitwise_or.reduceat(np.uint64(1) << (slots & np.uint64(63)), first) if len(word) else slots
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(ored.view(np.int64))], names=["word", "bit"])

    rows = shared.mapInArrow(_tables.lean(run), schema).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << max(0, bits - 6), dtype=np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bit").to_numpy().view(np.uint64)
    return out


def _id_hash(ids: np.ndarray) -> np.ndarray:
    return _words.mix(ids.astype(np.int64).view(np.uint64))


def _sequence_keys(words: _words.Words) -> np.ndarray:
    """128 bits of each text's words, as two columns."""
    return np.stack([words.window_hash(words.first[:-1], words.counts, second=k) for k in (False, True)], axis=1)


class _Firsts:
    """Rows that are the first of their word sequence, as a Bloom filter of (sequence, doc_id);
    None where there are too many for one. A copy let through by mistake judges itself."""

    def __init__(self, docs: DataFrame, bits: int) -> None:
        def run(batches):
            for batch in batches:
                for part in _words.pieces(batch, "text"):
                    keys = _sequence_keys(_words.split(part.column(1)))
                    yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(keys[:, k].view(np.int64)) for k in (0, 1)]], names=["doc_id", "k1", "k2"])

        def hashes(batches):
            for batch in batches:
                columns = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(_mixed(*columns).view(np.int64))], names=["hash"])

        rows = docs.mapInArrow(_tables.lean(run), "doc_id long, k1 long, k2 long").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"))
        rows = _tables.stored(rows, "sequences")
        n = rows.count()
        self.bits, self.sent = sized(n, bits), None
        if n * 10 <= 1 << bits:
            self.sent = docs.sparkSession.sparkContext.broadcast(_bloom(rows.select("k1", "k2", "doc_id").mapInArrow(_tables.lean(hashes), "hash long"), self.bits))
        _tables.discard(rows)

    def of(self, words: _words.Words, ids: np.ndarray) -> np.ndarray:
        if self.sent is None:
            return np.ones(len(words.counts), dtype=bool)
        keys = _sequence_keys(words)
        return _in_bloom(_mixed(keys[:, 0], keys[:, 1], ids.astype(np.int64).view(np.uint64)), self.sent.value, self.bits)


def _mixed(k1: np.ndarray, k2: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    return _words.mix(_words.mix(k1 ^ _words.mix(k2)) ^ _words.mix(doc_id))


def _taken(words: _words.Words, part: pa.RecordBatch, firsts: _Firsts, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the rows that are the first of their sequence."""
    at, doc, place = _places(words, length)
    mine = firsts.of(words, part.column(0).to_numpy(zero_copy_only=False))[doc]
    return at[mine], doc[mine], place[mine]


def _anchor_hashes(docs: DataFrame, firsts: _Firsts, size: int) -> DataFrame:
    """hash of every anchor, once a row."""
    length = size - PERIOD + 1

    def run(batches):
        for batch in batches:
            for part in _words.pieces(batch, "text"):
                words = _words.split(part.column(1))
                at, doc, _ = _taken(words, part, firsts, length)
                hashes = words.window_hash(at, length)
                order = np.argsort(hashes)
                order = order[np.argsort(doc[order], kind="stable")]
                hashes, doc = hashes[order], doc[order]
                new = np.append(True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, dtype=bool)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[new].view(np.int64))], names=["hash"])

    return docs.mapInArrow(_tables.lean(run), "hash long")


def _anchors(docs: DataFrame, firsts: _Firsts, size: int) -> DataFrame:
    """hash, doc_id, place (with the row's key) of every anchor."""
    length = size - PERIOD + 1

    def run(batches):
        for batch in batches:
            for part in _words.pieces(batch, "text"):
                words = _words.split(part.column(1))
                at, doc, place = _taken(words, part, firsts, length)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                keys = _row_keys(words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.window_hash(at, length).view(np.int64)), pa.array(ids[doc].astype(np.int64)), pa.array(keys[doc] + place)], names=["hash", "doc_id", "place"]
                )

    return docs.mapInArrow(_tables.lean(run), "hash long, doc_id long, place long")


def _window_rows(words: _words.Words, ids: np.ndarray, anchors: np.ndarray, size: int) -> pa.RecordBatch:
    """Rows for the windows around anchors (their first words), once each."""
    depth = np.zeros(len(words.begin) + 1, dtype=np.int64)
    doc = np.searchsorted(words.first, anchors, side="right") - 1
    begin = np.maximum(anchors - PERIOD + 1, words.first[doc])
    end = np.minimum(anchors + 1, words.first[doc + 1] - size + 1)
    fine = end > begin
    np.add.at(depth, begin[fine], 1)
    np.add.at(depth, end[fine], -1)
    at = np.flatnonzero(np.cumsum(depth) > 0)
    doc = np.searchsorted(words.first, at, side="right") - 1
    high = words.window_hash(at, size).view(np.int64)
    low = (words.window_hash(at, size, second=True) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    place = _row_keys(words)[doc] + (at - words.first[doc])
    return pa.RecordBatch.from_arrays([pa.array(high), pa.array(low), pa.array(ids[doc].astype(np.int64)), pa.array(place)], names=["high", "low", "doc_id", "place"])


_WINDOWS = "high long, low int, doc_id long, place long"


def _windows_by_bloom(docs: DataFrame, firsts: _Firsts, known, size: int, bits: int) -> DataFrame:
    length = size - PERIOD + 1

    def run(batches):
        bloom = known.value
        for batch in batches:
            for part in _words.pieces(batch, "text"):
                words = _words.split(part.column(1))
                at, _, _ = _taken(words, part, firsts, length)
                at = at[_in_bloom(words.window_hash(at, length), bloom, bits)]
                yield _window_rows(words, part.column(0).to_numpy(zero_copy_only=False), at, size)

    return docs.mapInArrow(_tables.lean(run), _WINDOWS)


def _windows_by_join(docs: DataFrame, firsts: _Firsts, shared: DataFrame, size: int) -> DataFrame:
    places = _anchors(docs, firsts, size).join(shared, "hash").groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    length = size - PERIOD + 1

    def run(batches):
        for batch in batches:
            for part in _words.pieces(batch, "text"):
                words = _words.split(part.column(1))
                at, doc, place = _taken(words, part, firsts, length)
                keys = _row_keys(words)
                mine = np.zeros(len(at), dtype=bool)
                for k, listed in enumerate(part.column(2).to_pylist()):
                    here = slice(*np.searchsorted(doc, (k, k + 1)))
                    mine[here] = np.isin(keys[k] + place[here], listed)
                yield _window_rows(words, part.column(0).to_numpy(zero_copy_only=False), at[mine], size)

    return docs.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(_tables.lean(run), _WINDOWS)


@_tables.shielded()
def repeats(docs: DataFrame, size: int = SIZE, text: str = "text", doc_id: str = "doc_id", bloom_bits: int = BLOOM_BITS, action: str = "report") -> DataFrame:
    """report: the rows with FIELDS (spans count words). text: each text becomes its kept words,
    joined by one space; null stays null."""
    if size < PERIOD:
        raise ValueError(f"windows need {PERIOD} words at least, not {size}")
    if action not in ("report", "text"):
        raise ValueError(f"action must be 'report' or 'text', not {action!r}")
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    firsts = _Firsts(named, bloom_bits)
    shared = _tables.stored(_anchor_hashes(named, firsts, size).groupBy("hash").count().where("count > 1").select("hash"), "shared-anchors")
    known = None
    n_shared = shared.count()
    if n_shared * 10 <= 1 << bloom_bits:
        known = send(_bloom(shared, sized(n_shared, bloom_bits)))
        windows = _windows_by_bloom(named, firsts, known, size, sized(n_shared, bloom_bits))
    else:
        windows = _windows_by_join(named, firsts, shared, size)
    _tables.release_shuffles(spark)
    # stored, so that a window of very many documents can be dealt to several tasks of the join
    least = windows.groupBy("high", "low").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    least = _tables.stored(least.select("high", "low", "least"), "first-holders")
    _tables.release_shuffles(spark)
    again = windows.join(least, ["high", "low"]).where("doc_id > least")
    found = again.groupBy("doc_id").agg(F.collect_list("place").alias("__places"))
    found = _tables.stored(found.select(F.col("doc_id").alias("__doc"), "__places"), "removals")
    _tables.discard(shared, least)
    if known is not None:
        known.destroy()
    _tables.release_shuffles(spark)
    hits, n_found = None, found.count()
    hit_bits = sized(n_found, bloom_bits)
    if n_found * 10 <= 1 << bloom_bits:

        def hashed(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(_id_hash(batch.column(0).to_numpy(zero_copy_only=False)).view(np.int64))], names=["hash"])

        hits = send(_bloom(found.select("__doc").mapInArrow(_tables.lean(hashed), "hash long"), hit_bits))

    def may_have(part: pa.RecordBatch) -> np.ndarray:
        ids = part.column(part.schema.get_field_index(doc_id)).fill_null(-1).to_numpy(zero_copy_only=False)
        return _in_bloom(_id_hash(ids), hits.value, hit_bits)

    def only(part: pa.RecordBatch) -> dict:
        return {None: np.flatnonzero(may_have(part))}

    as_text = action == "text"

    def judged(part: pa.RecordBatch, listed_places: list) -> dict:
        column = lambda name: part.column(part.schema.get_field_index(name))
        words = _words.split(column(text))
        keys = _row_keys(words)
        ids = column(doc_id)
        copies = ~firsts.of(words, ids.fill_null(-1).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
        n_removed, spans, shas, kept_texts = [], [], [], []
        raw = words.data.tobytes()
        for k, places in enumerate(listed_places):
            a, b = words.first[k], words.first[k + 1]
            kept = np.full(b - a, not (copies[k] and b - a >= size))
            if places:
                listed = np.array(places, dtype=np.int64) - keys[k]
                depth = np.zeros(b - a + 1, dtype=np.int64)
                listed = listed[(listed >= 0) & (listed <= b - a - size)]
                np.add.at(depth, listed, 1)
                np.add.at(depth, listed + size, -1)
                kept &= np.cumsum(depth[:-1]) <= 0
            left = np.flatnonzero(kept) + a
            line = b" ".join([raw[i:j] for i, j in zip(words.begin[left].tolist(), words.end[left].tolist())])
            if as_text:
                kept_texts.append(line.decode())
                continue
            n_removed.append(b - a - len(left))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], (~kept).astype(np.int8), [0]])))
            spans.append(edge.tolist())
            shas.append(hashlib.sha256(line).hexdigest())
        if as_text:
            nulls = column(text).is_null().to_pylist()
            return {text: pa.array([None if n else t for n, t in zip(nulls, kept_texts)], pa.string())}
        return {"n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "removed_spans": pa.array(spans, pa.list_(pa.int32())), "kept_sha256": pa.array(shas, pa.string())}

    def with_places():
        return lambda part: judged(part, part.column(part.schema.get_field_index("__places")).to_pylist())

    def without():
        def kernel(part: pa.RecordBatch) -> dict:
            rows = np.flatnonzero(~may_have(part))
            part = part.take(pa.array(rows))
            return {None: rows, **judged(part, [None] * len(rows))}

        return kernel

    fields = [T.StructField(text, docs.schema[text].dataType)] if as_text else FIELDS
    mine = docs if hits is None else _tables.scan_texts(docs, text, [], lambda: only)
    joined = mine.join(found, mine[doc_id] == found["__doc"], "left").drop("__doc")
    out = _tables.scan_texts(joined, text, fields, with_places, keep=docs.columns, also=(doc_id, "__places"))
    return out if hits is None else _tables.scan_texts(docs, text, fields, without, also=(doc_id,)).unionByName(out)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
