"""Vectorised scanning of Arrow string columns.

Texts stay in Arrow's own UTF-8 buffer.  Words are byte runs of a 256-entry mask.  A run of up to 15 bytes is
told apart by 128 bits that are its bytes and length, mixed by bijections, so no two runs share them; longer
runs are hashed by xxh3.  Nothing here builds a Python object per word, but for those longer ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64


def _rand64(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=U64)


_LANE = _rand64(64, 77003) | U64(1)
_SECOND = _rand64(64, 91009) | U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

#: [^\x20\x09-\x0D]
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased
ALNUM = np.zeros(256, bool)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    ALNUM[_a:_b + 1] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(31))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(29))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(32))


#: Masks of the first 0 to 8 bytes of a word of 8.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the 128 bits of each run of bytes [start, end)."""
    padded = np.append(data, np.zeros(16, np.uint8))
    eight = np.ndarray((len(padded) - 7,), U64, padded, 0, (1,))  # the 8 bytes from every byte on
    size = end - start
    one = eight[start] & _FIRST[np.minimum(size, 8)]
    two = (eight[start + np.minimum(size, 8)] & _FIRST[np.clip(size - 8, 0, 7)]) | (size.astype(U64) << U64(56))
    for i in np.flatnonzero(size > 15).tolist():
        raw = xxhash.xxh3_128_intdigest(padded[start[i]:end[i]], seed)
        one[i], two[i] = raw & 0xFFFFFFFFFFFFFFFF, raw >> 64
    salt = _rand64(2, seed)
    return mix(one ^ salt[0]), mix(two ^ salt[1])


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def blocks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes; a longer text is a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


class Words:
    """Words of a block of texts.

    start, end: byte positions in ``data``; first: index of each text's first word, with one more
    entry at the end.  Hashes and numbers are those of the folded bytes (A-Z lower-cased).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, mask: np.ndarray):
        n = len(data)
        self.data, self.offsets = data, offsets
        self._inside = inside = mask[data]
        begins = inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            heads = offsets[:-1][offsets[:-1] < offsets[1:]]
            begins[heads] = inside[heads]
        stops = inside.copy()
        if n:
            stops[:-1] &= ~inside[1:]
            tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
            stops[tails] = inside[tails]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, offsets)

    def wide(self, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of each word's 128 bits."""
        return run_hashes(LOWER[self.data], self.start, self.end, seed)

    @cached_property
    def hash(self) -> np.ndarray:
        one, two = self.wide()
        return mix(one + two * _SECOND[0])

    @cached_property
    def _dictionary(self) -> pa.DictionaryArray:
        size = self.end - self.start
        wide = int(size.sum()) >= 1 << 31
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64 if wide else np.int32)
        letters = LOWER[self.data[self._inside]]
        kind = pa.large_binary() if wide else pa.binary()
        return pa.Array.from_buffers(kind, len(size), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()

    @property
    def number(self) -> np.ndarray:
        """Which distinct word each one is, told apart by their bytes."""
        return self._dictionary.indices.to_numpy()

    def text(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def scan(column: pa.Array, mask: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for blocks of whole texts of a column."""
    raw, offs = string_buffers(column)
    for a, b in blocks(offs, limit):
        o = offs[a:b + 1]
        yield a, b, Words(raw[o[0]:o[-1]], o - o[0], mask)


def windows(h: np.ndarray, k: int, second: np.ndarray | None = None) -> np.ndarray:
    """Hash of every run of k consecutive word hashes (also those across texts); second: other halves of these."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, k, U64)
    for j in range(k):
        out += h[j:j + n] * _LANE[j % 64]
        if second is not None:
            out += second[j:j + n] * _SECOND[j % 64]
    return mix(out)


def exact_windows(number: np.ndarray, k: int) -> np.ndarray:
    """A number for every run of k consecutive word numbers: equal runs, and only these, have the same."""
    out, size = number.astype(np.int64), 1
    while size < k:  # runs of ``size`` words, made longer by one that overlaps it
        step = min(size, k - size)
        if len(out) <= step:
            return np.zeros(0, np.int64)
        pair = out[:-step] * (int(out.max()) + 1) + out[step:]
        out = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        size += step
    return out


def slices(batch: pa.RecordBatch, at: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``limit`` bytes of its string column ``at``: what is made of a piece stays small."""
    column = batch.column(at)
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    for a, b in blocks(offs, limit):
        yield batch.slice(a, b - a)
