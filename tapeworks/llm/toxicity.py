"""Toxicity by compression distance: one zstandard dictionary per class, compared by window.

A-Z are lower-cased, words are runs of letters, digits and non-ASCII. A window is ``WINDOW`` words
of a text with the spaces beside them, from every word on, and a constant tail of the ordinary
dictionary, without which zstandard stores so short an input as it is. Both dictionaries hold the
same ordinary language; the toxic one holds before it what zstandard's trainer keeps of the parts of
words of toxic texts whose byte n-grams are over-represented among toxic documents. A window's
distance is its compressed length under the ordinary dictionary less that under the toxic one; it is
absorbed when the toxic dictionary leaves little of it. A document's features are how many of its
windows, absolutely and as a share, reach each threshold of distance, absorbed or not; a logistic
model, calibrated on texts that the dictionaries of its fold have not seen, turns them into a score.
Equal windows are compressed once in a while: lengths are kept by their hash.

Learning takes at most ``FIT_ROWS`` labelled rows of either class, those of the least md5 of doc_id
(a documented bound: the sample doesn't grow with the corpus), and moves the scores to the share of
toxic rows among all labelled ones; every text is scored whole. Null and
empty texts score as texts without windows. A label that is null or not 0 or 1 is not used; of
several labels for a document each counts. Without both classes the score is the base rate of what
there is (0 if nothing is labelled). Repeats score alike; columns named like new ones are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.llm import _tables, _words

WINDOW = 1
FIT_ROWS = 2000
THRESHOLDS = (2, 3, 4, 5, 6, 8)
#: A window is absorbed when the toxic dictionary leaves this many bytes of it at most.
ABSORBED = 2
GRAMS = (5, 6, 8)
LEVEL, TAIL, TOXIC_BYTES, COMMON_BYTES = 9, 64, 1024, 4096
#: z of the two-proportion test from which an n-gram counts as over-represented.
MIN_Z, MIN_DOCS = 6.0, 4
PREDICT_AT = 0.7
#: Windows whose lengths a task keeps.
SLOTS = 1 << 20


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    base: float


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.pair = [self._compressor(d) for d in (model.ordinary, model.toxic)] if model.toxic else []
        self.weights = np.array(model.weights)
        self.floor = len(self.pair[0].compress(b" " + model.ordinary[-TAIL:])) if self.pair else 0
        self.slot_key = np.zeros(SLOTS, dtype=np.uint64)
        self.slot_d = np.zeros(SLOTS, dtype=np.int8)
        self.slot_whole = np.zeros(SLOTS, dtype=bool)

    @staticmethod
    def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, dict_size=len(raw), source_size=96, min_match=4, write_content_size=False, write_dict_id=False, write_checksum=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS
        )
        known.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=known, compression_params=params)

    def _distances(self, w: _words.Words) -> tuple[np.ndarray, np.ndarray]:
        """Of the window from each word on (to its text's end at most): distance, absorbed."""
        n = len(w.begin)
        if not n or not self.pair:
            return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        at = np.arange(n)
        last = np.minimum(at + WINDOW, np.repeat(w.first[1:], w.counts))
        keys = _words.mix(w.window_hash(at, last - at) + (last - at).astype(np.uint64)) | np.uint64(1)
        slot = (keys >> np.uint64(24)).astype(np.int64) & (SLOTS - 1)
        d, whole = self.slot_d[slot].astype(np.int64), self.slot_whole[slot]
        miss = np.flatnonzero(self.slot_key[slot] != keys)
        if len(miss):
            distinct, where, of = np.unique(keys[miss], return_index=True, return_inverse=True)
            raw, tail = w.data.tobytes(), b" " + self.model.ordinary[-TAIL:]
            begin, end = w.begin.tolist(), w.end.tolist()
            texts = [b" " + b" ".join([raw[begin[j] : end[j]] for j in range(k, last[k])]) + tail for k in miss[where].tolist()]
            size = np.array([len(t) for t in texts], dtype=np.uint64)
            source = zstandard.BufferWithSegments(b"".join(texts), np.stack([np.cumsum(size) - size, size], axis=1).tobytes())
            a, b = (np.fromiter(map(len, c.multi_compress_to_buffer(source)), dtype=np.int64, count=len(texts)) for c in self.pair)
            new_d, new_whole = a - b, b - self.floor <= ABSORBED
            d[miss], whole[miss] = new_d[of], new_whole[of]
            here = slot[miss[where]]
            self.slot_key[here], self.slot_d[here], self.slot_whole[here] = distinct, np.clip(new_d, -120, 120), new_whole
        return d, whole

    def features(self, texts: pa.Array) -> np.ndarray:
        w = _words.split(texts, _words.ALNUM, lower=True)
        n, doc = len(w.counts), w.doc
        d, whole = self._distances(w)
        out = [np.ones(n)]
        for t in THRESHOLDS:
            for kind in (d >= t, (d >= t) & whole):
                hits = np.bincount(doc[kind], minlength=n)
                out += [np.log1p(hits), np.sqrt(hits / np.maximum(w.counts, 1))]
        out.append(np.log1p(w.counts))
        return np.stack(out, axis=1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.pair:
            return np.full(len(texts), self.model.base)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -30, 30)))


def _padded(texts: list[str | None]) -> list[bytes]:
    """Per text its words, lower-cased, each with a space before and after."""
    w = _words.split(pa.array(texts, pa.string()), _words.ALNUM, lower=True)
    raw, begin, end = w.data.tobytes(), w.begin.tolist(), w.end.tolist()
    return [b" " + b"".join([raw[begin[k] : end[k]] + b" " for k in range(a, b)]) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())]


_BYTES = _words.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ROLLER = _words.Roller(0x9FB21C651E98DF25, 0x3C6EF372FE94F82B)


def _grams(line: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place and length of the n-grams of a padded line that lie in one word."""
    data = np.frombuffer(line, dtype=np.uint8)
    sums = _ROLLER.prefix(_BYTES[data])
    spaces = np.append(0, np.cumsum(data == 0x20))
    out = []
    for n in GRAMS:
        at = np.arange(max(0, len(data) - n + 1))
        at = at[spaces[at + n - 1] == spaces[at + 1]]
        out.append((_ROLLER.slices(sums, at, at + n) + np.uint64(n), at, np.full(len(at), n)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _support(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and how many lines have each; merged by 100 lines, so few are held twice."""
    grams, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    for k in range(0, len(lines), 100):
        new, n = np.unique(np.concatenate([np.unique(_grams(x)[0]) for x in lines[k : k + 100]]), return_counts=True)
        every, of = np.unique(np.concatenate([grams, new]), return_inverse=True)
        counts = np.bincount(of, weights=np.concatenate([counts, n]), minlength=len(every)).astype(np.int64)
        grams = every
    return grams, counts


def dictionaries(toxic: list[str | None], ordinary: list[str | None]) -> tuple[bytes, bytes]:
    """Raw contents of the ordinary and the toxic dictionary (empty: no n-gram stands out)."""
    tox, ordi = _padded(toxic), _padded(ordinary)
    (g1, k1), (g0, k0) = _support(tox), _support(ordi)
    n1, n0 = len(tox), len(ordi)
    g1, k1 = g1[k1 >= MIN_DOCS], k1[k1 >= MIN_DOCS]
    m = np.zeros(len(g1), dtype=np.int64)
    if len(g0):
        place = np.minimum(np.searchsorted(g0, g1), len(g0) - 1)
        m = np.where(g0[place] == g1, k0[place], 0)
    p = (k1 + m) / (n1 + n0)
    z = (k1 / n1 - m / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    marked = g1[z >= MIN_Z]
    samples = []
    for line in tox:
        hashes, at, n = _grams(line)
        hit = np.isin(hashes, marked)
        depth = np.zeros(len(line) + 1, dtype=np.int64)
        np.add.at(depth, at[hit], 1)
        np.add.at(depth, at[hit] + n[hit], -1)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(depth[:-1]) > 0).astype(np.int8), [0]])))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
            part = line[i:j]  # of one word or more: each with its spaces
            words = part.split(b" ")
            samples += [b" " * (k > 0) + w + b" " * (k < len(words) - 1) for k, w in enumerate(words) if w]
    common: Counter = Counter()
    for line in ordi:
        common.update(set(line.split()))
    lines = [b" " + w + b" " for w, k in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:5000] if k > 1 for _ in range(min(k, 20))]
    shared = _trained(lines, COMMON_BYTES)
    return shared, _trained(samples, TOXIC_BYTES) + shared if samples else b""


def _trained(samples: list[bytes], size: int) -> bytes:
    """What zstandard's trainer keeps of the samples, without header and entropy tables."""
    held = b"".join(dict.fromkeys(s for s, _ in Counter(samples).most_common()))
    if len(held) <= size:  # all of them fit, the most frequent last, where they are nearest
        return b"".join(s for s, _ in reversed(Counter(samples).most_common()))
    try:
        raw = zstandard.train_dictionary(size + 256, samples).as_bytes()
    except zstandard.ZstdError:
        return held[:size]
    return raw[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(rows: list[tuple[str | None, int]], folds: int = 3, share: float | None = None) -> Model:
    """rows: (text, label) in a fixed order. share: of toxic rows where these were sampled from;
    scores are moved to it from the sample's own."""
    labels = np.array([y for _, y in rows], dtype=np.float64)
    base = float(labels.mean()) if len(rows) else 0.0
    share = base if share is None or not 0 < share < 1 else share
    if len(set(labels.tolist())) < 2:
        return Model(b"", b"", (), base)
    rank = {0: 0, 1: 0}
    fold = np.zeros(len(rows), dtype=np.int64)
    for k, (_, y) in enumerate(rows):  # stratified
        fold[k], rank[y] = rank[y] % folds, rank[y] + 1
    of = lambda keep, label: [t for (t, y), f in zip(rows, keep) if f and y == label]
    found = np.zeros((len(rows), 4 * len(THRESHOLDS) + 2))
    for f in range(folds):
        ordinary, toxic = dictionaries(of(fold != f, 1) or [None], of(fold != f, 0) or [None])
        scorer = Scorer(Model(ordinary, toxic, (), base))
        mine = np.flatnonzero(fold == f)
        if len(mine):
            found[mine] = scorer.features(pa.array([rows[k][0] for k in mine], pa.string()))
    ordinary, toxic = dictionaries(of(fold >= 0, 1), of(fold >= 0, 0))
    weights = _logistic(found, labels)
    weights[0] += np.log(share / (1 - share)) - np.log(base / (1 - base))
    return Model(ordinary, toxic, tuple(weights.tolist()), base)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", rows: int = FIT_ROWS) -> Model:
    """Learn from labelled documents: the ``rows`` of each class with the least md5(doc_id)."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__y"))
    parts = [known.where(F.col("__y") == y).withColumn("__k", F.md5(F.col("__id").cast("string"))).orderBy("__k", "__id").limit(rows) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # twice ``rows`` at most
    found = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("t")).join(chosen, "__id").select("t", "__y", F.md5(F.col("__id").cast("string")).alias("k"))
    n = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}  # two rows
    share = n.get(1, 0) / max(sum(n.values()), 1)
    model = learn([(r["t"], r["__y"]) for r in sorted(found.collect(), key=lambda r: (r["k"], r["t"] or "", r["__y"]))], share=share)
    _tables.trim()  # the sample and its n-grams
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns, ``score`` and ``predicted``."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size and a few weights

    def make():
        scorer = Scorer(held.value)

        def kernel(part: pa.RecordBatch) -> dict:
            s = scorer.scores(part.column(part.schema.get_field_index(text)))
            return {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= PREDICT_AT).astype(np.int32), pa.int32())}

        return kernel

    return _tables.scan_texts(docs, text, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make)


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) leaves 1 modulo 3: never learned from. Null: no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _tables.table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    model = fit(docs, labels)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with their own columns alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(held.value)
        return lambda part: {None: np.flatnonzero(scorer.scores(part.column(part.schema.get_field_index(text))) < PREDICT_AT)}

    return _tables.scan_texts(docs, text, [], make)
