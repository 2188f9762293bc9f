"""Token ids on disk: fixed-size blocks, bit- or byte-plane transposed, zstandard, with an index.

One row of the store's Parquet files is one block of a writing task's id stream. ``planes``
holds the block's planes, each compressed alone (plane p of byte planes: byte p of every id;
of bit planes: bit p of every id, packed). Beside them stands the chunk index: how many of the
stream's ids are in blocks before, which documents have ids in the block, where, and how many
ids each has in all. Parquet's own compression is off; its commit protocol makes the write whole
or absent.

Documents are dealt by ranges of doc_id and sorted, so ids lie in ascending doc_id order by
(part, block); a document's global start is the sum of the parts before its own, which are as
many rows as writing tasks. Null texts count as empty; equal doc_ids keep one row each; null
doc_ids come first; further columns are not read; an empty table gives an empty store.
"""

from __future__ import annotations

import contextlib
import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.llm import _tables, _words

BLOCK = 1 << 16

#: Bytes of text that are cut at a time; the arrays beside them take some 30 times as much.
SLICE = 1 << 18

STORE = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("block", T.LongType()),
        T.StructField("before", T.LongType()),
        T.StructField("n_ids", T.IntegerType()),
        T.StructField("bits", T.IntegerType()),
        T.StructField("planes", T.ArrayType(T.BinaryType())),
        T.StructField("doc_id", T.ArrayType(T.LongType())),
        T.StructField("doc_row", T.ArrayType(T.LongType())),
        T.StructField("doc_start", T.ArrayType(T.LongType())),
        T.StructField("doc_n", T.ArrayType(T.LongType())),
        T.StructField("begin", T.ArrayType(T.IntegerType())),
        T.StructField("length", T.ArrayType(T.IntegerType())),
    ]
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _letters() -> np.ndarray:
    """Per byte: 1 in letters, 2 in digits, 3 white space and controls, 4 other ASCII, 0 unknown."""
    kind = np.zeros(256, dtype=np.uint8)
    kind[:0x80] = 4
    kind[:0x21] = kind[0x7F] = 3
    kind[0x30:0x3A] = 2
    kind[0x41:0x5B] = kind[0x61:0x7B] = 1
    return kind


_KIND = _letters()
#: First bytes of two-byte letters: U+00C0-U+017F and U+0400-U+047F, where all but two are letters.
_LEADS = np.isin(np.arange(256), (0xC3, 0xC4, 0xC5, 0xD0, 0xD1))


class PieceEncoder:
    """A byte-level BPE of the tokenizers library, applied once per distinct piece of text
    (and again where over ``room`` pieces were known, which are then dropped).

    The pre-tokenizer of such a BPE begins a token at a single space or line end between
    other characters and at every change between letters, digits and signs, and looks no
    further back. So a text is cut there, and its ids are those of its pieces in a row.
    Pieces of letters alone go straight to the BPE model, many in one call; any other piece
    goes through the whole tokenizer. Pieces with an apostrophe, with other white space or
    with characters of unknown class are not cut inside.
    """

    def __init__(self, path: str, room: int = 500_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with contextlib.suppress(AttributeError):
            self.tokenizer.model._resize_cache(0)  # pieces come once; the library's own cache only costs
        self.runs = Tokenizer(self.tokenizer.model)
        self.runs.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocab = self.tokenizer.get_vocab()
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        alphabet = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.alphabet = np.array([ord(alphabet[b]) for b in range(256)], dtype="<u4")
        self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, k in vocab.items():
            self.opens[k] = token.startswith(alphabet[0x20])
        self.space = alphabet[0x20]
        self.space_id = vocab.get(self.space)
        self.room = room
        self._reset()

    def _reset(self) -> None:
        self.slot_key = np.zeros(1 << 16, dtype=np.uint64)  # open addressing; keys are odd, 0 is free
        self.slot_entry = np.zeros(1 << 16, dtype=np.int64)  # where the piece's ids begin, by 2^32, and how many
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.known = self.used = 0

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the keys, and where in ``keys`` those without one are."""
        mask = len(self.slot_key) - 1
        slot = (keys >> np.uint64(20)).astype(np.int64) & mask
        entry = self.slot_entry[slot]
        left = np.flatnonzero(self.slot_key[slot] != keys)
        new = []
        while len(left):
            free = self.slot_key[slot[left]] == 0
            new.append(left[free])
            left = left[~free]
            slot[left] = slot[left] + 1 & mask
            entry[left] = self.slot_entry[slot[left]]
            left = left[self.slot_key[slot[left]] != keys[left]]
        return entry, np.concatenate(new) if new else left

    def _place(self, keys: np.ndarray, entry: np.ndarray) -> None:
        """Slots for distinct keys that have none."""
        mask = len(self.slot_key) - 1
        slot = (keys >> np.uint64(20)).astype(np.int64) & mask
        left = np.arange(len(keys))
        while len(left):
            free = left[self.slot_key[slot[left]] == 0]
            self.slot_key[slot[free]] = keys[free]  # of several for one slot the last stays
            left = left[self.slot_key[slot[left]] != keys[left]]
            slot[left] = slot[left] + 1 & mask
        self.slot_entry[slot] = entry

    def _append(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        entry = (self.used + np.cumsum(sizes) - sizes) << 32 | sizes
        self.used += len(ids)
        self.known += len(sizes)
        if 2 * self.known > len(self.slot_key):
            held = np.flatnonzero(self.slot_key)
            old_keys, old_entry = self.slot_key[held], self.slot_entry[held]
            room = 1 << (2 * self.known).bit_length()
            self.slot_key, self.slot_entry = np.zeros(room, dtype=np.uint64), np.zeros(room, dtype=np.int64)
            self._place(old_keys, old_entry)
        self._place(keys, entry)

    def _line(self, data: np.ndarray, first: np.ndarray, last: np.ndarray, between: str) -> np.ndarray:
        """Ids of slices of the data, in the BPE's alphabet and with ``between`` after each, as the model gives them."""
        between = np.frombuffer(between.encode("utf-32-le"), dtype="<u4")
        size = last - first + len(between)
        ends = np.cumsum(size)
        at = np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]))
        line = self.alphabet[data[np.minimum(at, len(data) - 1)]]
        for k, c in enumerate(between):
            line[ends - len(between) + k] = c
        found = self.runs.encode_batch_fast([line.tobytes().decode("utf-32-le")], add_special_tokens=False)
        return np.array(found[0].ids, dtype=np.uint32)

    def _learn(self, data: np.ndarray, keys: np.ndarray, first: np.ndarray, last: np.ndarray, strange: np.ndarray) -> None:
        """strange: how many bytes are not of letters."""
        spaced = (data[first] == 0x20) & (strange == 1) & (last - first > 1)
        bare = (strange == 0) & (self.space_id is not None)
        if spaced.any():
            ids = self._line(data, first[spaced], last[spaced], " ")
            self._append(keys[spaced], ids, np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids))))
        if bare.any():  # a lone space after each, which is in no token of letters
            ids = self._line(data, first[bare], last[bare], f" {self.space} ")
            ends = np.flatnonzero(ids == self.space_id)
            self._append(keys[bare], np.delete(ids, ends), np.diff(ends, prepend=-1) - 1)
        rest = ~(spaced | bare)
        if rest.any():
            some = [data[a:b].tobytes().decode() for a, b in zip(first[rest].tolist(), last[rest].tolist())]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            self._append(keys[rest], np.array([i for x in found for i in x], dtype=np.uint32), np.array([len(x) for x in found]))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has."""
        if self.known > self.room:
            self._reset()
        data, offsets = _words.buffers(texts)
        n_texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(n_texts, dtype=np.int64)
        first, odd = self._cut(data, offsets)
        last = np.append(first[1:], len(data))
        keys = _words.hash_slices(data, first, last) | np.uint64(1)
        entry, miss = self._find(keys)
        if len(miss):
            distinct, where = np.unique(keys[miss], return_index=True)
            a, b = first[miss[where]], last[miss[where]]
            self._learn(data, distinct, a, b, odd[b] - odd[a])
            entry[miss] = self._find(keys[miss])[0]
        sizes = entry & 0xFFFFFFFF
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat((entry >> 32) - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
        upto = np.append(0, ends)[np.searchsorted(first, offsets)]
        return ids, np.diff(upto)

    @staticmethod
    def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bytes of the pieces; and how many bytes before each are not of letters."""
        n = len(data)
        kind = _KIND[data]
        lead = np.flatnonzero(_LEADS[data[:-1]])
        lead = lead[~((data[lead] == 0xC3) & ((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7)))]
        kind[lead] = kind[lead + 1] = 1
        cut = np.zeros(n + 1, dtype=bool)
        # a change between letters, digits and signs of known class
        known = (kind != 0) & (kind != 3)
        cut[1:n] = known[1:] & known[:-1] & (kind[1:] != kind[:-1])
        # a single space or line end between other characters
        at = np.flatnonzero((data == 0x20) | (data == 0x0A))
        at = at[(at > 0) & (at < n - 1)]
        at = at[known[at - 1] & (known[at + 1])]
        cut[at] = True
        # after a line end the next piece begins
        ends = at[data[at] == 0x0A] + 1
        cut[ends] = True
        # none inside what holds an apostrophe: from the space before it to the next
        marks = np.flatnonzero(data == 0x27)
        if len(marks):
            stops = np.append(at, n)
            right = stops[np.searchsorted(stops, marks, side="right")]
            left = np.append(0, at)[np.searchsorted(at, marks, side="right")]
            held = np.flatnonzero(cut[:n])
            near = np.searchsorted(left, held) - 1  # of the marks that begin before, the last reaches furthest
            cut[held[(near >= 0) & (right[near] > held)]] = False
        starts = offsets[:-1][offsets[1:] > offsets[:-1]]
        cut[starts] = True
        odd = np.zeros(n + 1, dtype=np.int32)
        np.cumsum(kind != 1, out=odd[1:])
        return np.flatnonzero(cut[:n]), odd


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> PieceEncoder:
    """A worker's encoder: its next task finds the pieces known to the last."""
    return PieceEncoder(path)


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, p].tobytes() for p in range(4)]
    if kind != "bit":
        raise ValueError(f"planes must be 'byte' or 'bit', not {kind!r}")
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, p]).tobytes() for p in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        raw = np.empty((n, 4), dtype=np.uint8)
        for p, plane in enumerate(planes):
            raw[:, p] = np.frombuffer(plane, dtype=np.uint8)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n) for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def _blocks(stream: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], part: int, kind: str, size: int, level: int):
    """Store rows of a stream of (ids, counts, doc_ids)."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=level)
    block, rows, done = 0, 0, 0  # done: ids in blocks that are out
    ids = np.zeros(0, dtype=np.uint32)
    held: list[np.ndarray] = []  # of documents with ids that wait: doc_id, row, start, n

    def emit(n: int):
        nonlocal block, ids, done, held
        docs = np.concatenate(held, axis=1)
        start, count = docs[2], docs[3]
        here = start < done + n
        begin = np.maximum(start[here] - done, 0)
        length = np.minimum(start[here] + count[here] - done, n) - begin
        planes = [packer.compress(p) for p in to_planes(ids[:n], kind)]
        row = (part, block, done, n, 8 if kind == "byte" else 1, planes, *docs[:, here], begin, length)
        held = [docs[:, start + count > done + n]]
        block, done, ids = block + 1, done + n, ids[n:]
        columns = [pa.array([v if not isinstance(v, np.ndarray) else v.tolist()], type=t) for v, t in zip(row, _ARROW)]
        return pa.RecordBatch.from_arrays(columns, names=STORE.names)

    for new, counts, doc_ids in stream:
        starts = done + len(ids) + np.cumsum(counts) - counts
        held.append(np.stack([doc_ids, rows + np.arange(len(counts)), starts, counts]))
        rows += len(counts)
        ids = np.concatenate([ids, new])
        while len(ids) >= size:
            yield emit(size)
    if len(ids):
        yield emit(len(ids))


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_ARROW = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.binary()), _LONGS, _LONGS, _LONGS, _LONGS, _INTS, _INTS]

#: Stands for a null doc_id inside the blocks.
NO_ID = -(1 << 63)


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = 2,
    text: str = "text",
    doc_id: str = "doc_id",
    planes: str = "byte",
    block: int = BLOCK,
    level: int = 3,
) -> str:
    """Encode every text, append ``end_id``, and write the store at ``path``."""
    file = tokenizer or default_tokenizer()
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library would start a thread for each of the machine
        encoder = _encoder(file)

        def stream():
            for batch in batches:
                for piece in _words.pieces(batch, "text", SLICE):
                    ids, counts = encoder.texts(piece.column(1))
                    cuts = np.cumsum(counts)
                    ids = np.insert(ids, cuts, np.uint32(end_id))
                    yield ids, counts + 1, piece.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)

        yield from _blocks(stream(), TaskContext.get().partitionId(), planes, block, level)

    ordered.mapInArrow(_tables.lean(run), STORE).write.option("compression", "none").parquet(path)
    return path


def read_ids(spark: SparkSession, path: str):
    """The store as a frame of blocks; decode a row's ids with ``decode``."""
    return spark.read.schema(STORE).parquet(path)


def decode(planes: list[bytes], n: int) -> np.ndarray:
    import zstandard

    unpacker = zstandard.ZstdDecompressor()
    return from_planes([unpacker.decompress(p) for p in planes], n)


def _times(matrix: tuple[int, ...], vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector >>= 1
        k += 1
    return out


@functools.cache
def _zeros(power: int) -> tuple[int, ...]:
    """What 2^power zero bytes do to a crc32, as a matrix of bits."""
    step = (0xEDB88320, *(1 << k for k in range(31))) if power == 0 else _zeros(power - 1)  # one zero bit at first
    for _ in range(3 if power == 0 else 1):
        step = tuple(_times(step, row) for row in step)
    return step


def crc_joined(first: int, second: int, length: int) -> int:
    """crc32 of a + b from crc32(a), crc32(b) and len(b): shift a's by len(b) zero bytes."""
    power = 0
    while length:
        if length & 1:
            first = _times(_zeros(power), first)
        length >>= 1
        power += 1
    return first ^ second


_PIECES = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("doc_row", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("doc_start", T.LongType()),
        T.StructField("doc_n", T.LongType()),
        T.StructField("crc", T.LongType()),
    ]
)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    A document's crc is the exclusive or of its pieces' crcs, each shifted by the document's bytes after it."""
    store = read_ids(spark, path)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # one at a time, as planes are large
                row = {name: batch.column(i)[k] for i, name in enumerate(STORE.names)}
                part, before, n = (row[c].as_py() for c in ("part", "before", "n_ids"))
                doc_id, doc_row, start, count, begin, length = (
                    row[c].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "doc_row", "doc_start", "doc_n", "begin", "length")
                )
                raw = memoryview(decode(row["planes"].as_py(), n).view(np.uint8))
                after = start + count - (before + begin + length)
                ends = begin + length
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist())]
                for i in np.flatnonzero(after).tolist():
                    crc[i] = crc_joined(crc[i], 0, 4 * int(after[i]))
                columns = [pa.array(np.full(len(crc), part, dtype=np.int32)), doc_row, pa.array(doc_id, mask=doc_id == NO_ID), start, count, np.array(crc, dtype=np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=_PIECES.names)

    parts = store.mapInArrow(_tables.lean(run), _PIECES)
    whole = parts.groupBy("part", "doc_row").agg(*[F.first(c).alias(c) for c in ("doc_id", "doc_start", "doc_n")], F.bit_xor("crc").alias("crc"))
    totals = store.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return whole.join(F.broadcast(before), "part").select(  # a row for each writing task
        "doc_id", (F.col("before") + F.col("doc_start")).alias("start"), F.col("doc_n").alias("n_tokens"), F.col("crc").alias("ids_crc32")
    )


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _tables.table(spark, sf_dir, "documents")
    path = write_tokens(docs, _tables.fresh_path(spark, "tokens"))
    return digests(spark, path)
