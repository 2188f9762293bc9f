"""Benchmark decontamination: windows of normalised test words, looked up in every document.

A-Z are lower-cased; words are runs of ASCII letters, digits and all that is not ASCII. A
window is ``size`` consecutive words of a benchmark item; an item of fewer words, but not
none, is one window. Every document word inside an occurrence of a window is hit. Hashes of
the windows are broadcast and looked up for each place of a document; each hit is verified
word by word. A document with hits is contaminated when at least a ``1/share`` of its words
is hit.

What is broadcast is bounded: benchmarks of over ``block_bytes`` of text are dealt into
blocks of about that size, and the documents go through one pass per block, with a stored
table between passes. Null texts have no words; items without words never occur; repeated
items each count; repeated documents are judged row by row; an empty benchmark hits nothing.
Columns of the documents that are named like report columns are replaced in the report and
kept by the filters.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.llm import _tables, _words

SIZE, SHARE, BLOCK_BYTES = 13, 20, 32 << 20

REPORT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
    T.StructField("hit_spans", T.ArrayType(T.IntegerType())),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]
_SPANS, _ITEMS = "__hit_spans", "__hit_items"
_BITS = 22


class WindowSet:
    """The windows of items (id, text), by length, as sorted hashes over the items' own bytes:
    some 50 bytes a word, whatever the windows share. Hits are verified byte by byte."""

    def __init__(self, items: list[tuple[str, str | None]], size: int) -> None:
        self.ids = [i for i, _ in items]
        words = _words.split(pa.array([t for _, t in items], pa.string()), _words.ALNUM, lower=True)
        self.data, self.begin, self.end, self.owner = words.data, words.begin, words.end, words.doc.astype(np.int32)
        self.by_size: dict[int, tuple] = {}
        self.same: dict[tuple[int, int], list[tuple[bytes, set[int]]]] = {}
        grouped: dict[int, list[np.ndarray]] = defaultdict(list)
        for k, n in enumerate(words.counts):
            if n:
                here = int(words.first[k])
                grouped[min(int(n), size)].append(np.arange(here, here + max(1, int(n) - size + 1)))
        for length, starts in grouped.items():
            at = np.concatenate(starts)
            keys = words.window_hash(at, length)
            order = np.argsort(keys, kind="stable")
            bits = np.zeros(1 << _BITS, dtype=bool)
            bits[keys >> np.uint64(64 - _BITS)] = True
            self.by_size[length] = (bits, keys[order], at[order])

    def _line(self, a: int, length: int) -> bytes:
        raw, begin, end = self.data, self.begin, self.end
        return b" ".join([raw[begin[j] : end[j]].tobytes() for j in range(a, a + length)])

    def _owners(self, length: int, place: int) -> list[tuple[bytes, set[int]]]:
        """The different windows of one hash, from its first place on, with their items; kept."""
        known = self.same.get((length, place))
        if known is None:
            _, hashes, starts = self.by_size[length]
            found: dict[bytes, set[int]] = defaultdict(set)
            for a in starts[place : np.searchsorted(hashes, hashes[place], side="right")].tolist():
                found[self._line(a, length)].add(int(self.owner[a]))
            known = self.same[length, place] = list(found.items())
        return known

    def occurrences(self, words: _words.Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words lie inside an occurrence, and the items by document."""
        depth = np.zeros(len(words.begin) + 1, dtype=np.int64)
        items: dict[int, set[int]] = defaultdict(set)
        for length, (bits, hashes, _) in self.by_size.items():
            at = words.windows(length)
            if not len(at):
                continue
            keys = words.window_hash(at, length)
            maybe = np.flatnonzero(bits[keys >> np.uint64(64 - _BITS)])
            if not len(maybe):
                continue
            place = np.minimum(np.searchsorted(hashes, keys[maybe]), len(hashes) - 1)
            hit = hashes[place] == keys[maybe]
            maybe, place = maybe[hit], place[hit]
            docs = np.searchsorted(words.first, at[maybe], side="right") - 1
            for p, a, doc in zip(place.tolist(), at[maybe].tolist(), docs.tolist()):
                line = b" ".join([words.word(j) for j in range(a, a + length)])
                for other, owners in self._owners(length, p):
                    if other == line:
                        depth[a] += 1
                        depth[a + length] -= 1
                        items[doc] |= owners
        return np.cumsum(depth[:-1]) > 0, items


def spans_of(hit: np.ndarray) -> list[int]:
    """Flat [begin, end, begin, end, ...] of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge.tolist()


def _pass(frame: DataFrame, text: str, windows, share: int, last: str | None) -> DataFrame:
    """One block's pass. last: None keeps what was found for the next pass, else the action."""
    fields = {
        None: [T.StructField(_SPANS, T.ArrayType(T.IntegerType())), T.StructField(_ITEMS, T.ArrayType(T.StringType()))],
        "report": REPORT,
        "documents": [],
        "spans": [T.StructField(text, frame.schema[text].dataType)],
    }[last]
    again = _SPANS in frame.columns

    def make():
        known: WindowSet = windows.value

        def kernel(part: pa.RecordBatch) -> dict:
            texts = part.column(part.schema.get_field_index(text))
            words = _words.split(texts, _words.ALNUM, lower=True)
            hit, items = known.occurrences(words)
            names = {doc: {known.ids[i] for i in found} for doc, found in items.items()}
            if again:
                for doc, (spans, more) in enumerate(zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in (_SPANS, _ITEMS)))):
                    for a, b in zip(spans[::2], spans[1::2]):
                        hit[words.first[doc] + a : words.first[doc] + b] = True
                    if more:
                        names[doc] = names.get(doc, set()) | set(more)
            sums = np.append(0, np.cumsum(hit))
            n_hit = sums[words.first[1:]] - sums[words.first[:-1]]
            bad = (n_hit > 0) & (share * n_hit >= words.counts)
            if last == "documents":
                return {None: np.flatnonzero(~bad)}
            spans = [spans_of(hit[a:b]) if n else [] for a, b, n in zip(words.first[:-1], words.first[1:], n_hit)]
            if last == "spans":
                new = texts.to_pylist()
                for doc in np.flatnonzero(n_hit):
                    raw, base, first = new[doc].encode(), words.offsets[doc], words.first[doc]
                    kept, upto = [], 0
                    for a, b in zip(spans[doc][::2], spans[doc][1::2]):
                        kept.append(raw[upto : words.begin[first + a] - base])
                        upto = words.end[first + b - 1] - base
                    new[doc] = (b"".join(kept) + raw[upto:]).decode()
                return {text: pa.array(new, pa.string())}
            listed = [sorted(names.get(doc, ())) for doc in range(len(n_hit))]
            spans, listed_arrow = pa.array(spans, pa.list_(pa.int32())), pa.array(listed, pa.list_(pa.string()))
            if last is None:
                return {_SPANS: spans, _ITEMS: listed_arrow}
            return {
                "n_words": pa.array(words.counts, pa.int64()),
                "n_hit": pa.array(n_hit, pa.int64()),
                "n_items": pa.array([len(x) for x in listed], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed], pa.string()),
                "contaminated": pa.array(bad, pa.bool_()),
                "hit_spans": spans,
                "hit_items": listed_arrow,
            }

        return kernel

    own = (_SPANS, _ITEMS) if again else ()
    keep = [c for c in frame.columns if c not in (_SPANS, _ITEMS)]
    return _tables.scan_texts(frame, text, fields, make, keep=keep, also=own)


@_tables.shielded()
def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    action: str = "report",
    size: int = SIZE,
    share: int = SHARE,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """report: the documents with REPORT's columns (spans count words). documents: contaminated
    rows go. spans: hit words go from the texts, each run with what stands between its words."""
    if action not in ("report", "documents", "spans"):
        raise ValueError(f"action must be 'report', 'documents' or 'spans', not {action!r}")
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    out = docs
    for b in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        windows = spark.sparkContext.broadcast(WindowSet([(r.i, r.t) for r in mine.collect()], size))  # block_bytes of text
        out = _pass(out, text, windows, share, action if b == blocks - 1 else None)
        if b < blocks - 1:
            out = _tables.stored(out, "decontaminate")
    return out


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, _tables.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
