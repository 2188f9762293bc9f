"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters, one check a pair.

A-Z are lower-cased, words are runs without ASCII white space; a document's set holds its
distinct shingles of ``shingle`` words (with fewer words, the whole sequence as one). Two sets
link when 100 * intersection >= ``percent`` * union. Equal sets form one class and only classes
are compared, each by the row of its least doc_id. A set's tokens are ordered by how often their
cell of a count table occurs in all documents, rare first, then by hash: any one global order
finds every link. The table has a cell for each shingle of the corpus, up to 2^``MAX_BITS``. Of
two sets that link, the larger one's prefix and the smaller one's shorter index prefix share a
token, at places that leave enough tokens after it (positional filter), and their tokens fall
into hash bins with enough overlap (suffix filter, on the pairs that are left).

No group is paired with itself. In each of ``rounds`` every token names a pivot, the class
that has it earliest; the token's other classes are checked against the pivot alone, and then
the pivot leaves the token, as all its pairs are done. Links found so far make components, and
a token whose classes are in one component is done. Tokens that still hold more than ``HOT``
classes are split by the next token that two sets would have to share (prefixes are one token
longer for that); then classes outside a token's largest component are paired with those of
other components. Pairs are checked once, on whole sets.

Null, empty and wordless texts have empty sets and link with nothing. Repeated doc_ids and
rows each count; a null doc_id never names a component unless all its members are null.
Further columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.llm import _tables, _words, repeats
from tapeworks.llm.components import components

SHINGLE, PERCENT = 3, 90
BINS, ROUNDS = 16, 2
#: The count table: cells at most (4 bits each, so 64 MB are broadcast), cells of the ranges it
#: is merged by, shingles a task holds between two of its contributions.
MAX_BITS, RANGE_BITS, HELD = 27, 18, 1 << 22
#: Occurrences from which a cell is of the next level; equal levels are ordered by hash.
LEVELS = np.array([2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256, 1024, 4096, 16384])
#: Classes of a token from which it is split by a second one.
HOT = 64


def _sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted in each text; their texts; set sizes."""
    words = _words.split(texts, _words.NONSPACE, lower=True)
    at = words.windows(shingle)
    doc = words.doc[at] if len(at) else at
    short = np.flatnonzero((words.counts > 0) & (words.counts < shingle))
    at, size = np.append(at, words.first[short]), np.append(np.full(len(at), shingle), words.counts[short])
    doc = np.append(doc, short)
    keys = _words.mix(words.window_hash(at, size) + size.astype(np.uint64))
    order = np.argsort(keys)
    order = order[_stable(doc[order], len(words.counts))]
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    keys, doc = keys[new], doc[new]
    return keys, doc, np.bincount(doc, minlength=len(words.counts))


def _stable(small: np.ndarray, n: int) -> np.ndarray:
    """A stable order of numbers under ``n``; by radix where they fit 16 bits."""
    return np.argsort(small.astype(np.uint16) if n <= 1 << 16 else small, kind="stable")


def _class_keys(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """128 bits of each set, as two columns."""
    out = np.zeros((n, 2), dtype=np.uint64)
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, dtype=np.int64)
    for c, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
        if len(starts):
            out[doc[starts], c] = np.add.reduceat(_words.mix(keys ^ np.uint64(salt)), starts)
    return out


def _binary(keys: np.ndarray) -> list[bytes]:
    raw = keys.astype(">u8").tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


#: Of a row: doc_id, set size, class. Of a contribution to the count table: range, cells.
_SCAN = "doc_id long, n long, key binary, range int, cells binary"


def table_bits(docs: DataFrame, most: int = MAX_BITS) -> int:
    """Bits of a cell's number: about as many cells as the texts have words."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(most, max(12, (size // 6).bit_length()))


def scan(docs: DataFrame, shingle: int, bits: int) -> DataFrame:
    """Rows and count-table contributions of all texts, in one pass. Cells go sorted, as the
    bytes of their differences, by plane, which the shuffle's compression takes well."""
    shift = min(bits, RANGE_BITS)
    ranges = 1 << (bits - shift)

    def contributions(held: list[np.ndarray]) -> pa.RecordBatch:
        cells = np.sort(np.concatenate(held))
        cut = np.searchsorted(cells, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(shift))
        blobs, have = [], np.flatnonzero(np.diff(cut))
        for r in have.tolist():
            inside = cells[cut[r] : cut[r + 1]].astype(np.int64) - (r << shift)
            blobs.append(np.diff(inside, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
        k = len(have)
        empty = pa.nulls(k, pa.int64())
        return pa.RecordBatch.from_arrays([empty, empty, pa.nulls(k, pa.binary()), pa.array(have.astype(np.int32)), pa.array(blobs, pa.binary())], names=["doc_id", "n", "key", "range", "cells"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in _words.pieces(batch, "text"):
                keys, doc, n = _sets(part.column(1), shingle)
                held.append((keys >> np.uint64(64 - bits)).astype(np.uint32))
                size += len(keys)
                rows = len(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(_binary(_class_keys(keys, doc, rows)), pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                    names=["doc_id", "n", "key", "range", "cells"],
                )
                if size >= HELD:
                    yield contributions(held)
                    held, size = [], 0
        if size:
            yield contributions(held)

    return docs.mapInArrow(_tables.lean(run), _SCAN)


def count_levels(scanned: DataFrame, bits: int) -> np.ndarray:
    """The level of each cell over all texts, two to a byte; 2^(bits - 1) bytes."""
    width = 1 << min(bits, RANGE_BITS)
    ranges = (1 << bits) // width

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                planes = np.frombuffer(blob.as_buffer(), dtype=np.uint8).reshape(4, -1)
                cells = np.cumsum(np.ascontiguousarray(planes.T).view("<u4").reshape(-1), dtype=np.int64)
                if r not in totals:
                    totals[r] = np.zeros(width, dtype=np.int64)
                at = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
                totals[r][cells[at]] += np.diff(np.append(at, len(cells)))
        for r, total in totals.items():
            level = np.searchsorted(LEVELS, total, side="right").astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([(level[::2] | level[1::2] << 4).tobytes()], pa.binary())], names=["range", "levels"])

    merged = scanned.where("range IS NOT NULL").select("range", "cells").repartition(ranges, "range").mapInArrow(_tables.lean(run), "range int, levels binary")
    out = np.zeros((ranges, width // 2), dtype=np.uint8)
    for row in merged.toLocalIterator():  # of fixed size
        out[row["range"]] = np.frombuffer(row["levels"], dtype=np.uint8)
    return out.reshape(-1)


def prefix_sizes(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the probe prefix (partners as large or smaller) and the index prefix."""
    least = -(-percent * n // 100)
    equal = -(-2 * percent * n // (100 + percent))
    return n - least + 1, n - equal + 1


def _bloom_keys(key: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    return _words.mix(key[:, 0] ^ _words.mix(doc_id.astype(np.int64).view(np.uint64)))


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(-1).to_numpy(zero_copy_only=False)


class _Chosen:
    """Rows of given (key, doc_id), told in tasks by two Bloom filters while they are few enough:
    one of ids alone, before a text's set is made, and one of both. Beyond, rows are joined."""

    def __init__(self, docs: DataFrame, wanted: DataFrame, bloom_bits: int, ids_too: bool) -> None:
        n = wanted.count()
        self.docs, self.wanted, self.bits = docs, wanted, repeats.sized(n, bloom_bits)
        self.sparse = n * 10 <= 1 << bloom_bits
        self.both = self.ids = None
        if self.sparse:
            send = docs.sparkSession.sparkContext.broadcast
            self.both = send(self._filter("key", "doc_id"))
            self.ids = send(self._filter("doc_id")) if ids_too else None

    def _filter(self, *names: str) -> np.ndarray:
        def hashes(batch: pa.RecordBatch) -> np.ndarray:
            ids = _ids(batch.column(batch.num_columns - 1))
            raw = np.zeros((len(ids), 2), dtype=np.uint64)
            if batch.num_columns == 2:
                raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, 2)
            return _bloom_keys(raw, ids)

        return repeats._bloom(self.wanted.select(*names), self.bits, hashes)

    def source(self) -> DataFrame:
        if self.sparse:
            return self.docs
        ids = self.wanted.select(F.col("doc_id").alias("__id")).distinct()
        return self.docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("doc_id", "text")

    def rows_of_ids(self, part: pa.RecordBatch) -> pa.RecordBatch:
        if self.ids is None:
            return part
        ids = _ids(part.column(0))
        return part.take(pa.array(np.flatnonzero(repeats._in_bloom(_bloom_keys(np.zeros((len(ids), 2), dtype=np.uint64), ids), self.ids.value, self.bits))))

    def rows(self, classes: np.ndarray, ids: pa.Array) -> np.ndarray:
        if self.both is None:
            return np.ones(len(classes), dtype=bool)
        return repeats._in_bloom(_bloom_keys(classes, _ids(ids)), self.both.value, self.bits)

    def for_tasks(self) -> "_Chosen":
        """Without frames, which don't travel."""
        out = object.__new__(_Chosen)
        out.docs = out.wanted = None
        out.bits, out.sparse, out.both, out.ids = self.bits, self.sparse, self.both, self.ids
        return out

    def close(self) -> None:
        for sent in (self.both, self.ids):
            if sent is not None:
                sent.destroy()


def signatures(docs: DataFrame, chosen: _Chosen, levels, shingle: int, percent: int, bits: int) -> DataFrame:
    """Of the chosen rows whose sets can link with others: key, n, tokens (probe prefix and one
    more, rare first), bins."""
    task = chosen.for_tasks()

    def run(batches):
        known = levels.value
        for batch in batches:
            for part in _words.pieces(batch, "text"):
                keys, doc, n = _sets(part.column(1), shingle)
                rows = len(n)
                classes = _class_keys(keys, doc, rows)
                mine = (n > 0) & (100 * n >= percent * (n + 1)) & task.rows(classes, part.column(0))
                bins = np.bincount(doc * BINS + (keys & np.uint64(BINS - 1)).astype(np.int64), minlength=rows * BINS).astype(np.int32).reshape(rows, BINS)
                inside = mine[doc]
                keys, doc, n = keys[inside], doc[inside], np.where(mine, n, 0)
                cell = (keys >> np.uint64(64 - bits)).astype(np.int64)
                level = known[cell >> 1] >> ((cell & 1) << 2).astype(np.uint8) & np.uint8(15)
                order = np.argsort(level, kind="stable")
                order = order[_stable(doc[order], rows)]
                place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                taken = np.where(n > 0, np.minimum(prefix_sizes(n, percent)[0] + 1, n), 0)
                tokens = keys[order][place < taken[doc]].view(np.int64)
                at = pa.array(np.append(0, np.cumsum(taken[mine])).astype(np.int32))
                all_bins = pa.array(np.arange(mine.sum() + 1, dtype=np.int32) * BINS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_binary(classes[mine]), pa.binary()), pa.array(n[mine], pa.int64()), pa.ListArray.from_arrays(at, pa.array(tokens)), pa.ListArray.from_arrays(all_bins, pa.array(bins[mine].reshape(-1)))],
                    names=["key", "n", "tokens", "bins"],
                )

    if chosen.sparse:
        return docs.mapInArrow(_tables.lean(run), "key binary, n long, tokens array<long>, bins array<int>")

    def named(batches):  # with the doc_id, by which rows are joined
        for batch in batches:
            for k in range(batch.num_rows):
                for out in run([batch.slice(k, 1)]):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, out.num_rows), *out.columns], names=["doc_id", *out.schema.names])

    rows = docs.mapInArrow(_tables.lean(named), "doc_id long, key binary, n long, tokens array<long>, bins array<int>")
    w = chosen.wanted.select(F.col("key").alias("__key"), F.col("doc_id").alias("__id"))
    return rows.join(w, (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").drop("doc_id")


def _whole_sets(docs: DataFrame, wanted: DataFrame, shingle: int, bloom_bits: int) -> tuple[DataFrame, _Chosen]:
    """key and its whole set, of the wanted (key, doc_id), found by scanning the texts again."""
    chosen = _Chosen(docs, wanted, bloom_bits, ids_too=True)
    task = chosen.for_tasks()

    def run(batches):
        for batch in batches:
            for part in _words.pieces(task.rows_of_ids(batch), "text"):
                keys, doc, n = _sets(part.column(1), shingle)
                classes = _class_keys(keys, doc, len(n))
                mine = (n > 0) & task.rows(classes, part.column(0))
                taken = keys[mine[doc]].view(np.int64)
                sets = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[mine])).astype(np.int32)), pa.array(taken))
                yield pa.RecordBatch.from_arrays([pa.array(_binary(classes[mine]), pa.binary()), sets], names=["key", "set"])

    return chosen.source().mapInArrow(_tables.lean(run), "key binary, set array<long>"), chosen


def _live_rows(sig: DataFrame, percent: int, bloom_bits: int) -> DataFrame:
    """A row for each class and prefix token that two classes have: token, key, n, place. Which
    tokens these are goes to the tasks as a Bloom filter while they are few enough (a token let
    through by mistake pairs with nothing), else they are joined."""
    spark = sig.sparkSession
    prefix = F.slice("tokens", F.lit(1), (F.col("n") - F.ceil(F.lit(percent) * F.col("n") / F.lit(100) - F.lit(1e-9)) + 1).cast("int"))
    shared = _tables.stored(sig.select(F.explode(prefix).alias("token")).groupBy("token").count().where("count > 1").select("token"), "shared-tokens")
    n_shared = shared.count()
    bits = repeats.sized(n_shared, bloom_bits)
    if n_shared * 10 > 1 << bloom_bits:
        out = _tables.stored(sig.select("key", "n", F.posexplode(prefix).alias("place", "token")).join(shared, "token").select("token", "key", "n", "place"), "prefixes")
        _tables.discard(shared)
        return out
    known = spark.sparkContext.broadcast(repeats._bloom(shared, bits))

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            tokens = lists.flatten().to_numpy().view(np.uint64)
            n = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
            hit = np.flatnonzero(repeats._in_bloom(tokens, known.value, bits))
            mine = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays([pa.array(tokens[hit].view(np.int64)), *[batch.column(k).take(mine) for k in range(2)], pa.array(place[hit].astype(np.int32))], names=["token", "key", "n", "place"])

    out = _tables.stored(sig.select("key", "n", prefix.alias("tokens")).mapInArrow(_tables.lean(run), "token long, key binary, n long, place int"), "prefixes")
    known.destroy()
    _tables.discard(shared)
    return out


def _needed(nx: Column, ny: Column, percent: int) -> Column:
    return F.ceil(F.lit(percent) * (nx + ny) / F.lit(100 + percent) - F.lit(1e-9))


def _filters(x: str, y: str, percent: int) -> Column:
    """Length and positional filters of two prefix rows with one token."""
    c = lambda side, name: F.col(f"{side}.{name}")
    nx, ny = c(x, "n"), c(y, "n")
    length = F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent
    return length & (F.least(nx - c(x, "place"), ny - c(y, "place")) >= _needed(nx, ny, percent))


def _of_keys(sig: DataFrame, keys: DataFrame, bloom_bits: int) -> tuple[DataFrame, object]:
    """Signatures of given classes, and some others where a Bloom filter tells them (to be destroyed
    by the caller); joined where there are too many for one. Either is no larger than it must be,
    so that what is shuffled next grows with the keys, not with the corpus."""

    def hashed(batch: pa.RecordBatch) -> np.ndarray:
        return _words.mix(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, 2)[:, 0])

    n = keys.count()
    if n * 10 > 1 << bloom_bits:
        return sig.join(keys, "key", "left_semi"), None

    bits = repeats.sized(n, bloom_bits)
    known = sig.sparkSession.sparkContext.broadcast(repeats._bloom(keys, bits, hashed))

    def run(batches):
        for batch in batches:
            yield batch.take(pa.array(np.flatnonzero(repeats._in_bloom(hashed(batch), known.value, bits))))

    return sig.select("key", *[c for c in sig.columns if c != "key"]).mapInArrow(_tables.lean(run), sig.schema), known


def _suffix_filter(pairs: DataFrame, sig: DataFrame, percent: int) -> DataFrame:
    """Pairs whose tokens fall into hash bins with enough overlap."""
    side = lambda name, k: sig.select(F.col("key").alias(name), F.col("n").alias(f"n{k}"), F.col("bins").alias(f"bins{k}"))
    overlap = F.aggregate(F.zip_with("bins1", "bins2", lambda a, b: F.least(a, b)), F.lit(0), lambda s, v: s + v)
    return pairs.join(side("a", 1), "a").join(side("b", 2), "b").where(overlap >= _needed(F.col("n1"), F.col("n2"), percent)).select("a", "b").distinct()


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("key").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("key").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    whole = F.size("sa") + F.size("sb") - both
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= whole * percent).select("a", "b")


def _split_hot(now: DataFrame, sig: DataFrame, hot: int, bloom_bits: int) -> tuple[DataFrame, object]:
    """Rows of tokens with labels to pair, with ``second``: 0, or for tokens of more than ``hot``
    rows one row for each token that may be the next one two linked sets share. And a broadcast."""
    tokens = now.groupBy("token").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.count("*").alias("m")).where("l1 <> l2").select("token", "m")
    mine = _tables.stored(now.join(tokens, "token"), "open")
    cold = mine.where(F.col("m") <= hot).withColumn("second", F.lit(0).cast("long")).drop("m")
    wide = mine.where(F.col("m") > hot).drop("m")
    few, sent = _of_keys(sig, wide.select("key").distinct(), bloom_bits)
    later = few.select("key", F.posexplode("tokens").alias("next", "second"))
    wide = wide.join(later, "key").where("next > place").drop("next")
    return cold.unionByName(wide.select(cold.columns)), sent


def jaccard_classes(docs: DataFrame, shingle: int, percent: int, rounds: int, text: str, doc_id: str, bloom_bits: int, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """doc_id, n and key of all rows; and of each class its key, least doc_id and component's label."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    bits = table_bits(docs)
    scanned = _tables.stored(scan(docs, shingle, bits), "scan")
    rows = scanned.where("range IS NULL").select("doc_id", "n", "key")
    least = _tables.stored(rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id")), "classes")
    chosen = _Chosen(docs, least, bloom_bits, ids_too=False)
    levels = spark.sparkContext.broadcast(count_levels(scanned, bits))  # of a size with a bound
    sig = _tables.stored(signatures(docs, chosen, levels, shingle, percent, bits), "signatures")
    levels.destroy()
    chosen.close()
    _tables.trim()
    live = _live_rows(sig, percent, bloom_bits)
    _tables.release_memory(spark)
    labels = links = done = None

    def labelled() -> DataFrame:
        if labels is None:
            return live.withColumn("label", F.col("key"))
        known = live.join(labels.withColumnRenamed("node", "key"), "key", "left")
        return known.withColumn("label", F.coalesce("label", "key"))

    def check(pairs: DataFrame) -> None:
        nonlocal labels, links, done
        pairs = pairs.select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b")).distinct()
        near = _tables.stored(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "near")
        few, sent = _of_keys(sig.select("key", "n", "bins"), near.select(F.col("a").alias("key")).unionByName(near.select(F.col("b").alias("key"))).distinct(), bloom_bits)
        pairs = _tables.stored(_suffix_filter(near, few, percent), "pairs")
        _tables.discard(near)
        if sent is not None:
            sent.destroy()
        asked = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
        wanted = _tables.stored(asked.join(least, "key"), "wanted")
        whole, picked = _whole_sets(docs, wanted, shingle, bloom_bits)
        sets = _tables.stored(whole, "sets")
        found = _tables.stored(_linked(pairs, sets, percent).distinct(), "links")
        picked.close()
        _tables.discard(wanted, sets, labels)
        done = pairs if done is None else done.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        _tables.release_memory(spark)

    for _ in range(rounds):
        now = labelled()
        pivot = F.min(F.struct("place", "n", "key", "label")).alias("p")
        tokens = now.groupBy("token").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), pivot, F.count("*").alias("m")).where("l1 <> l2").select("token", "p", "m")
        tokens = _tables.stored(tokens, "pivots")  # a plain side, so that a hot token can be dealt to several tasks
        met = now.join(tokens, "token").where(F.col("key") != F.col("p.key")).select("token", "key", "n", "place", "label", "p", "m")
        met = _tables.stored(met, "met")
        _tables.discard(tokens)
        both = met.select(F.struct("n", "place", "label", "key").alias("x"), F.col("p").alias("y"))
        pairs = both.where((F.col("x.label") != F.col("y.label")) & _filters("x", "y", percent))
        check(pairs.select(F.col("x.key").alias("k1"), F.col("y.key").alias("k2")))
        _tables.discard(live)
        live = met.where("m > 2").select("token", "key", "n", "place")  # of two, nobody is left to meet
        _tables.rename(met, live)

    split, sent = _split_hot(_tables.stored(labelled(), "labelled"), sig, hot, bloom_bits)
    rest = _tables.stored(split, "rest")
    if sent is not None:
        sent.destroy()
    sizes = rest.groupBy("token", "second", "label").count()
    majors = sizes.groupBy("token", "second").agg(F.max(F.struct("count", "label")).alias("m"), F.count("*").alias("labels")).where("labels > 1").select("token", "second", F.col("m.label").alias("major"))
    majors = _tables.stored(majors, "majors")
    minor = rest.join(majors, ["token", "second"]).where("label <> major").alias("x")
    of_open = rest.join(majors.select("token", "second"), ["token", "second"]).alias("y")
    index = lambda a: F.col(f"{a}.n") - F.ceil(F.lit(2 * percent) * F.col(f"{a}.n") / F.lit(100 + percent) - F.lit(1e-9)) + 1
    probes = lambda a, b: (F.col(f"{a}.n") >= F.col(f"{b}.n")) & (F.col(f"{b}.place") < index(b))
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.second") == F.col("y.second"))
    pairs = minor.join(of_open, same).where((F.col("x.label") != F.col("y.label")) & (probes("x", "y") | probes("y", "x")) & _filters("x", "y", percent))
    check(pairs.select(F.col("x.key").alias("k1"), F.col("y.key").alias("k2")))
    _tables.discard(live, rest, majors, sig)

    classes = least.join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", "doc_id", F.coalesce("label", "key").alias("label"))
    return rows, classes


def jaccard_components(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, rounds: int = ROUNDS, text: str = "text", doc_id: str = "doc_id", bloom_bits: int = repeats.BLOOM_BITS, hot: int = HOT
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id."""
    rows, classes = jaccard_classes(docs, shingle, percent, rounds, text, doc_id, bloom_bits, hot)
    firsts = classes.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = classes.join(firsts, "label").select("key", "component_id")
    result = rows.join(named, "key", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return result.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


@_tables.shielded()
def keep_one(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, rounds: int = ROUNDS, text: str = "text", doc_id: str = "doc_id", bloom_bits: int = repeats.BLOOM_BITS
) -> DataFrame:
    """One row of each component, with all columns: the least doc_id's, of equal ids the least
    text's. Rows without words all stay."""
    _, classes = jaccard_classes(docs, shingle, percent, rounds, text, doc_id, bloom_bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("m")
    winners = classes.groupBy("label").agg(first).select(F.col("m.doc_id").alias("__first"), F.col("m.key").alias("__winner"))

    def make():
        def kernel(part: pa.RecordBatch) -> dict:
            keys, doc, n = _sets(part.column(part.schema.get_field_index(text)), shingle)
            return {"__key": pa.array(_binary(_class_keys(keys, doc, len(n))), pa.binary()), "__n": pa.array(n, pa.int64())}

        return kernel

    keyed = _tables.scan_texts(docs, text, [T.StructField("__key", T.BinaryType()), T.StructField("__n", T.LongType())], make)
    mine = keyed.where("__n > 0").join(winners, (F.col("__key") == F.col("__winner")) & F.col(doc_id).cast("long").eqNullSafe(F.col("__first")))
    one = Window.partitionBy("__winner", "__first").orderBy(text)
    mine = mine.withColumn("__r", F.row_number().over(one)).where("__r = 1")
    return keyed.where("__n = 0").select(docs.columns).unionByName(mine.select(docs.columns))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_tables.table(spark, sf_dir, "documents"))
