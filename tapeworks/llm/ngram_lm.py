"""Language-model scores: an interpolated modified Kneser-Ney bigram model, counted in Spark.

A-Z are lower-cased; tokens are the words without ASCII white space and one end per text. The model
lies in the shared folder as sorted arrays, in shards: the vocabulary's 64-bit word hashes by their
upper bits (a word's id is its place), the bigrams as ids (context << 32 | word) by a hash of the
context, with counts and each context's sums. Workers map the files into memory and search them; no
table passes through the driver. Texts' bigrams travel as compressed blocks of sorted ids, one per
shard and slice, so a frequent context costs no more rows than a rare one.

Discounts come from counts of counts (of bigrams, and of the distinct contexts of words for the lower
order); where these are too few, D is 0.5, 1, 1.5. Probabilities over the V known tokens and one
unknown sum to 1 in every context. Null and empty texts are their end alone. Repeated rows each
count and score; a null doc_id is in training. Without training texts every token is unknown: 1.
The shared folder must be a mounted one (file:), since workers map its files.
"""

from __future__ import annotations

import math
import os
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.llm import _tables, _words

#: Hash of the end; ids of words follow the order of hashes.
END = np.uint64(0x0123456789ABCDEF)
VOCAB_BITS = 6
#: Bigrams that one shard holds about.
SHARD_ROWS = 1 << 21
FOLDS = 10
#: Bytes of text in a slice; larger ones make fewer, denser blocks.
SLICE = 3 << 20

FIELDS = [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")] + [T.StructField(n, T.DoubleType()) for n in ("base_score", "score")]


def mounted(path: str) -> str:
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"the model's folder must be mounted where workers run, not {path}")
    return parts.path


def _save(path: str, array: np.ndarray) -> None:
    """Whole or absent, also when two attempts of a task write it."""
    draft = f"{path}.{os.getpid()}.tmp"
    with open(draft, "wb") as f:
        np.save(f, array)
    os.replace(draft, path)


def _load(path: str) -> np.ndarray:
    out = np.load(path, mmap_mode="r")
    return out


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys and counts, as byte planes of differences, compressed."""
    import zstandard

    step = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    small = np.minimum(counts, 255).astype(np.uint8)
    large = counts[counts >= 255].astype("<i8")
    raw = np.int64(len(keys)).tobytes() + np.ascontiguousarray(step).tobytes() + small.tobytes() + large.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    step = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n).T).view("<u8").reshape(-1)
    counts = np.frombuffer(raw, np.uint8, n, 8 + 8 * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<i8", -1, 8 + 9 * n)
    return np.cumsum(step, dtype=np.uint64), counts


def _merged(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack(b) for b in blocks]
    return _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of the slice, per token its place among them, and tokens before each text."""
    words = _words.split(texts, _words.NONSPACE, lower=True)
    n = len(words.counts)
    first = words.first + np.arange(n + 1)  # one end per text before
    hashes = np.empty(len(words.begin) + n, dtype=np.uint64)
    hashes[np.arange(len(words.begin)) + np.repeat(np.arange(n), words.counts)] = words.hash
    hashes[first[1:] - 1] = END
    distinct, of = np.unique(hashes, return_inverse=True)
    return distinct, of, first


def _by_shard(blocks: DataFrame, write, schema: str) -> DataFrame:
    """write(shard, keys, counts) -> row, for each shard's merged blocks (shard, block)."""

    def run(batches):
        held: list[bytes] = []
        now = None
        rows = []

        def flush():
            if now is not None:
                rows.append(write(now, *_merged(held)))
                held.clear()

        for batch in batches:
            for shard, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard != now:
                    flush()
                    now = shard
                held.append(block)
        flush()
        arrow = [pa.int64() if f.dataType.typeName() == "long" else pa.binary() if f.dataType.typeName() == "binary" else pa.list_(pa.int64()) for f in fields]
        for row in rows:
            yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, arrow)], names=[f.name for f in fields])

    fields = T.StructType.fromDDL(schema).fields
    return blocks.repartition("shard").sortWithinPartitions("shard").mapInArrow(_tables.lean(run), schema)


def _runs(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, dtype=np.int64)


class Vocabulary:
    """Hashes to ids (0 to size - 1; ``size``: unknown) and counts, from mapped files."""

    def __init__(self, root: str, sizes: list[int]) -> None:
        self.root, self.offsets, self.size = root, np.append(0, np.cumsum(sizes)), int(sum(sizes))
        self.shards: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted hashes."""
        ids = np.full(len(hashes), self.size, dtype=np.int64)
        counts = np.zeros(len(hashes), dtype=np.int64)
        upper = (hashes >> np.uint64(64 - VOCAB_BITS)).astype(np.int64)
        edges = np.searchsorted(upper, np.arange(len(self.offsets)))
        for s in np.unique(upper).tolist():
            if self.offsets[s] == self.offsets[s + 1]:
                continue
            if s not in self.shards:
                self.shards[s] = (_load(f"{self.root}/vocab-{s}.keys.npy"), _load(f"{self.root}/vocab-{s}.n.npy"))
            keys, n = self.shards[s]
            mine = hashes[edges[s] : edges[s + 1]]
            place = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            hit = np.flatnonzero(keys[place] == mine)
            ids[edges[s] + hit] = self.offsets[s] + place[hit]
            counts[edges[s] + hit] = n[place[hit]]
        return ids, counts


def _shard_of(context: np.ndarray, shards: int) -> np.ndarray:
    return (_words.mix(context.astype(np.uint64)) & np.uint64(shards - 1)).astype(np.int64)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ of modified Kneser-Ney from how many n-grams occur 1, 2, 3, 4 times."""
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    return tuple(min(max(d, 0.01), k + 0.99) for k, d in enumerate(raw))


class Model:
    """What the driver knows of a model: sizes, sums and discounts; workers map the rest."""

    def __init__(self, root: str, sizes: list[int], train_tokens: int, shards: int, blocks: int, high: tuple, low: tuple, n_bigrams: int, low_counts: list[int]) -> None:
        self.root, self.sizes, self.train_tokens, self.shards, self.blocks = root, sizes, train_tokens, shards, blocks
        self.high, self.low, self.n_bigrams, self.low_counts = high, low, n_bigrams, low_counts


class Scorer:
    def __init__(self, model: Model) -> None:
        self.m = model
        self.vocab = Vocabulary(model.root, model.sizes)
        self.files: dict[int, list[np.ndarray]] = {}
        self.low_blocks: dict[int, np.ndarray] = {}

    def _lower(self, ids: np.ndarray) -> np.ndarray:
        """P of words by their distinct contexts; ids sorted."""
        m, v = self.m, self.vocab.size
        counts = np.zeros(len(ids), dtype=np.int64)
        block = ids >> 20
        for b in np.unique(block[ids < v]).tolist():
            if b not in self.low_blocks:
                self.low_blocks[b] = _load(f"{m.root}/low-{b}.npy")
            mine = np.flatnonzero((block == b) & (ids < v))
            counts[mine] = self.low_blocks[b][ids[mine] & ((1 << 20) - 1)]
        if not m.n_bigrams:
            return np.ones(len(ids))
        d = np.array([0.0, *m.low])
        left = sum(d * n for d, n in zip(m.low, m.low_counts)) / m.n_bigrams
        return np.maximum(counts - d[np.minimum(counts, 3)], 0) / m.n_bigrams + left / (v + 1)

    def bigrams(self, context: np.ndarray, word: np.ndarray, lower: np.ndarray) -> np.ndarray:
        m = self.m
        out = lower.copy()
        shard = _shard_of(context, m.shards)
        d = np.array([0.0, *m.high])
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(m.shards + 1))
        for s in range(m.shards):
            mine = order[edges[s] : edges[s + 1]]
            if not len(mine) or not os.path.exists(f"{m.root}/pairs-{s}.keys.npy"):
                continue
            if s not in self.files:
                self.files[s] = [_load(f"{m.root}/pairs-{s}.{x}.npy") for x in ("keys", "n", "over", "contexts", "sums")]
            keys, n, over, contexts, sums = self.files[s]
            c, w = context[mine].astype(np.uint64), word[mine].astype(np.uint64)
            at = np.minimum(np.searchsorted(contexts, c), len(contexts) - 1)
            seen = contexts[at] == c
            mine, at, c, w = mine[seen], at[seen], c[seen], w[seen]
            key = c << np.uint64(32) | w
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            count = np.where(keys[place] == key, n[place], 0).astype(np.int64)
            full = np.flatnonzero(count == 255)
            if len(full):
                count[full] = over[1][np.searchsorted(over[0], place[full])]
            total = sums[0][at]
            left = (sums[1:4][:, at] * d[1:, None]).sum(axis=0) / total
            out[mine] = np.maximum(count - d[np.minimum(count, 3)], 0) / total + left * lower[mine]
        return out

    def columns(self, texts: pa.Array) -> dict:
        distinct, of, first = _tokens(texts)
        ids, counts = self.vocab.find(distinct)
        m, v = self.m, self.vocab.size
        starts, n = first[:-1], np.diff(first)
        known = np.add.reduceat((counts[of] > 0).astype(np.int64), starts) if len(n) else n
        base = np.log10((counts + 0.1) / (m.train_tokens + 0.1 * (v + 1)))[of]
        context = np.empty(len(of), dtype=np.int64)
        word = ids[of]
        context[1:] = word[:-1]
        context[starts] = v + 1  # a text's start
        key, back = np.unique(context.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64), return_inverse=True)
        c, w = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        low_ids, low_of = np.unique(w, return_inverse=True)
        p = self.bigrams(c, w, self._lower(low_ids)[low_of])
        score = np.log10(p)[back]
        total = lambda x: np.add.reduceat(x, starts) if len(n) else np.zeros(0)
        return {"n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(len(n), m.train_tokens), pa.int64()), "base_score": pa.array(total(base), pa.float64()), "score": pa.array(total(score), pa.float64())}


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Count the model of all texts into a fresh folder of the shared one."""
    spark = docs.sparkSession
    docs = docs.select(F.col(text).alias("text"))
    root = mounted(_tables.fresh_path(spark, "ngram-lm"))
    os.makedirs(root, exist_ok=True)

    def count_words(batches):
        for batch in batches:
            for part in _words.pieces(batch, "text", SLICE):
                distinct, of, _ = _tokens(part.column(0))
                n = np.bincount(of, minlength=len(distinct))
                edges = np.searchsorted(distinct >> np.uint64(64 - VOCAB_BITS), np.arange((1 << VOCAB_BITS) + 1, dtype=np.uint64))
                rows = [(s, pack(distinct[a:b], n[a:b])) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "block"])

    def write_words(shard, keys, counts):
        _save(f"{root}/vocab-{shard}.keys.npy", keys)
        _save(f"{root}/vocab-{shard}.n.npy", counts)
        return shard, len(keys), int(counts.sum())

    found = _by_shard(docs.mapInArrow(_tables.lean(count_words), "shard long, block binary"), write_words, "shard long, size long, n long").collect()  # a row a shard
    sizes = [0] * (1 << VOCAB_BITS)
    for r in found:
        sizes[r["shard"]] = r["size"]
    tokens = sum(r["n"] for r in found)
    _tables.release_shuffles(spark)
    shards = 1 << max(4, math.ceil(math.log2(max(1, tokens) / SHARD_ROWS)))

    def count_pairs(batches):
        vocab = Vocabulary(root, sizes)
        for batch in batches:
            for part in _words.pieces(batch, "text", SLICE):
                distinct, of, first = _tokens(part.column(0))
                word = vocab.find(distinct)[0][of]
                context = np.empty(len(of), dtype=np.int64)
                context[1:] = word[:-1]
                context[first[:-1]] = vocab.size + 1
                keys, n = np.unique(context.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64), return_counts=True)
                shard = _shard_of(keys >> np.uint64(32), shards)
                order = np.argsort(shard, kind="stable")
                keys, n = keys[order], n[order]
                edges = np.searchsorted(shard[order], np.arange(shards + 1))
                rows = [(s, pack(keys[a:b], n[a:b])) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "block"])

    def write_pairs(shard, keys, counts):
        contexts = keys >> np.uint64(32)
        first = _runs(contexts)
        sums = np.stack([np.add.reduceat(x, first).astype(np.float64) for x in (counts, counts == 1, counts == 2, counts >= 3)])
        full = np.flatnonzero(counts >= 255)
        _save(f"{root}/pairs-{shard}.keys.npy", keys)
        _save(f"{root}/pairs-{shard}.n.npy", np.minimum(counts, 255).astype(np.uint8))
        _save(f"{root}/pairs-{shard}.over.npy", np.stack([full, counts[full]]))
        _save(f"{root}/pairs-{shard}.contexts.npy", contexts[first])
        _save(f"{root}/pairs-{shard}.sums.npy", sums)
        return shard, len(keys), [int((counts == k).sum()) for k in (1, 2, 3, 4)]

    pairs = _by_shard(docs.mapInArrow(_tables.lean(count_pairs), "shard long, block binary"), write_pairs, "shard long, size long, times array<long>").collect()  # a row a shard
    _tables.release_shuffles(spark)
    times = [sum(r["times"][k] for r in pairs) for k in range(4)]

    def contexts_of(batches):
        """Each shard's words with how many of its contexts they follow, by blocks of ids."""
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                words, n = np.unique(_load(f"{root}/pairs-{shard}.keys.npy") & np.uint64(0xFFFFFFFF), return_counts=True)
                edges = np.append(_runs(words >> np.uint64(20)), len(words))
                rows = [(int(words[a] >> np.uint64(20)), pack(words[a:b], n[a:b])) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "block"])

    def write_low(block, words, counts):
        dense = np.zeros(1 << 20, dtype=np.int32)
        dense[(words & np.uint64((1 << 20) - 1)).astype(np.int64)] = np.minimum(counts, (1 << 31) - 1)
        _save(f"{root}/low-{block}.npy", dense)
        return block, [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [int((counts >= 3).sum())]

    listed = spark.createDataFrame([(r["shard"],) for r in pairs], "shard long").repartition(max(1, min(len(pairs), 512)), "shard")
    low = _by_shard(listed.mapInArrow(_tables.lean(contexts_of), "shard long, block binary"), write_low, "shard long, times array<long>").collect()  # a row per 2^20 words
    low_times = [sum(r["times"][k] for r in low) for k in range(5)]
    _tables.release_shuffles(spark)
    return Model(root, sizes, tokens, shards, len(low), discounts(times), discounts(low_times[:4]), sum(r["size"] for r in pairs), [low_times[0], low_times[1], low_times[4]])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns and FIELDS; scores are log10 probabilities of whole texts."""

    def make():
        scorer = Scorer(model)
        return lambda part: scorer.columns(part.column(part.schema.get_field_index(text)))

    return _tables.scan_texts(docs, text, FIELDS, make, limit=SLICE)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def op10_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *[f.name for f in FIELDS])
