"""Vectorised splitting and hashing of texts, on the bytes of Arrow strings.

A table of 256 flags says which bytes belong to words; word classes that only exclude
ASCII bytes can be cut on UTF-8 bytes. A word's hash chains its 8-byte pieces through a
bijection that is not algebraic (blake2b beyond 256 bytes), so no pattern of letters makes
words of equal hash. A window's hash is a polynomial of its words' hashes over the ring of
64-bit integers, taken from prefix sums, so a batch costs a few numpy passes. The second
window hash rests on word hashes of another seed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: ASCII white space: space and 0x09-0x0D.
SPACES = bytes([0x20, *range(0x09, 0x0E)])

_MASK = (1 << 64) - 1


def nonspace_table() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, dtype=bool)
    table[list(SPACES)] = False
    return table


def alnum_table() -> np.ndarray:
    """Bytes of words of ASCII letters and digits and all that is not ASCII."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


def lower_table() -> np.ndarray:
    """Lower case of A-Z; every other byte stays."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


NONSPACE, ALNUM, LOWER = nonspace_table(), alnum_table(), lower_table()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all 64 (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Roller:
    """Hashes of slices of a sequence: odd base, powers kept for the longest input so far."""

    def __init__(self, base: int, seed: int) -> None:
        self.base, self.seed = base | 1, seed
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) >= n:
            return
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for base in (self.base, self.inverse):
            p = np.ones(size, dtype=np.uint64)
            filled, step = 1, base
            while filled < size:  # doubling: p[k+i] = p[i] * base^k
                take = min(filled, size - filled)
                p[filled : filled + take] = p[:take] * np.uint64(step)
                filled += take
                step = step * step & _MASK if filled < size else step
            out.append(p)
        self.up, self.down = out

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        self._powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * self.up[:n], out=sums[1:])
        return sums

    def slices(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (sums[end] - sums[begin]) * self.down[begin]
        return mix(raw + np.uint64(self.seed))


#: Bytes of a word that are hashed in numpy passes; what is longer goes to blake2b.
_CHAINED = 256


def hash_slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of slices of bytes (one byte each at least)."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    length = end - begin

    def piece(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        unused = (np.uint64(8) - np.minimum(left, 8).astype(np.uint64)) * np.uint64(8)
        return (eight[at] << unused) >> unused

    out = mix(piece(begin, length) ^ mix(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 + seed & _MASK)))
    more, done = np.flatnonzero(length > 8), 8
    while len(more) and done < _CHAINED:
        out[more] = mix((out[more] << np.uint64(1) | out[more] >> np.uint64(63)) ^ piece(begin[more] + done, length[more] - done))
        done += 8
        more = more[length[more] > done]
    for k in more.tolist():
        rest = hashlib.blake2b(data[begin[k] + done : end[k]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest()
        out[k] = mix(out[k : k + 1] ^ np.frombuffer(rest, dtype="<u8"))[0]
    return out


_FIRST = Roller(0xAF251AF3B0F025B5, 0x14057B7EF767814F)
_SECOND = Roller(0xC6BC279692B5C323, 0x2545F4914F6CDD1D)


class Words:
    """The words of a run of texts: begin, end (bytes), doc (row), first (per row, n+1)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = table[data]
        left = np.empty(n + 1, dtype=bool)
        left[0] = left[n] = False
        left[1:n] = inside[:-1] if n else False
        edge = offsets[(offsets > 0) & (offsets < n)]
        left[edge] = False  # a text begins anew
        begin = np.flatnonzero(inside & ~left[:n])
        right = np.zeros(n, dtype=bool)
        if n:
            right[:-1] = inside[1:]
            right[edge - 1] = False
        self.begin, self.end = begin, np.flatnonzero(inside & ~right) + 1
        self.first = np.searchsorted(begin, offsets)
        self.counts = np.diff(self.first)
        self._hash = None

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = hash_slices(self.data, self.begin, self.end)
        return self._hash

    def windows(self, size: int) -> np.ndarray:
        """First words of the windows of that many words that lie in one text."""
        n = len(self.begin)
        if n < size:
            return np.zeros(0, dtype=np.int64)
        last = np.repeat(self.first[1:], self.counts)
        at = np.arange(n)
        return at[at + size <= last]

    def window_hash(self, at: np.ndarray, size, second: bool = False) -> np.ndarray:
        roller = _SECOND if second else _FIRST
        key = "_sums2" if second else "_sums1"
        sums = getattr(self, key, None)
        if sums is None:
            sums = roller.prefix(hash_slices(self.data, self.begin, self.end, 0x6A09E667F3BCC909) if second else self.hash)
            setattr(self, key, sums)
        return roller.slices(sums, at, at + size)

    def word(self, k: int) -> bytes:
        return self.data[self.begin[k] : self.end[k]].tobytes()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    n = len(texts)
    if n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def split(texts: pa.Array, table: np.ndarray = NONSPACE, lower: bool = False) -> Words:
    data, offsets = buffers(texts)
    return Words(LOWER[data] if lower else data, offsets, table)


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Slices of a batch of about ``limit`` bytes of text each (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.diff(buffers(batch.column(batch.schema.get_field_index(column)))[1]) + 64
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)
