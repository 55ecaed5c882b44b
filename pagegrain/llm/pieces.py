"""Pre-tokenisation of byte-level BPE in NumPy.

Splits texts as the public pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` does, for a block
of texts at once: classes of code points, runs of a class, then the rules for single spaces,
white space and contractions on the borders of runs.  Equal pieces of a block are found by Arrow's
dictionary, which compares their bytes, so an encoder only sees each distinct piece of a block.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

from . import textscan

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_HELD: dict[str, np.ndarray] = {}


def classes() -> np.ndarray:
    """Class of every code point."""
    if "classes" not in _HELD:
        kinds = {"L": LETTER, "N": NUMBER}
        t = np.frombuffer(bytes(kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8).copy()
        t[_SPACES] = SPACE
        _HELD["classes"] = t
    return _HELD["classes"]


def split(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the pieces of a block of texts; bounds: start of each text, and the end."""
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[code]
    head = np.zeros(n + 1, bool)
    head[bounds] = True
    start = head[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    start[0] = True
    at = np.flatnonzero(start)
    end = np.append(at[1:], n)
    what = kind[at]

    white = np.flatnonzero((what == SPACE) & ~head[end])  # white space with text behind it
    start[end[white] - 1] = True
    plain = white[code[end[white] - 1] == 0x20]
    start[end[plain]] = False  # one space goes with what follows

    quote = np.flatnonzero((code[at] == 0x27) & (end - at == 1) & start[at] & ~head[end])
    quote = quote[what[np.minimum(quote + 1, len(at) - 1)] == LETTER]
    if len(quote):
        i, stop = at[quote], end[quote + 1]
        one = code[i + 1]
        two = np.where(i + 2 < stop, code[np.minimum(i + 2, n - 1)], 0)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for a, b in ("re", "ve", "ll"):
            size = np.where((size == 0) & (one == ord(a)) & (two == ord(b)), 3, size)
        i, size, stop = i[size > 0], size[size > 0], stop[size > 0]
        start[i + 1] = False
        rest = i + size < stop
        start[(i + size)[rest]] = True
    return np.flatnonzero(start)


class Block:
    """Pieces of a block of texts: which distinct piece each one is, and where texts begin.

    data: UTF-8 bytes of the distinct pieces, in order of first occurrence; start, end: where each is in them.
    """

    def __init__(self, texts: Sequence[str]):
        whole = "".join(texts)
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        start = split(code, bounds)
        self.first = np.searchsorted(start, bounds)  # first piece of each text
        width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        ends = np.append(at[start], at[-1])  # pieces stand one after the other
        wide = int(at[-1]) >= 1 << 31
        kind, step = (pa.large_string(), np.int64) if wide else (pa.string(), np.int32)
        found = pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(ends.astype(step)), pa.py_buffer(whole.encode())]).dictionary_encode()
        self.which = found.indices.to_numpy()
        self._distinct = found.dictionary
        self.data, offsets = textscan.string_buffers(found.dictionary)
        self.start, self.end = offsets[:-1], offsets[1:]

    def __len__(self) -> int:
        return len(self._distinct)

    def pieces(self, at: np.ndarray | slice = slice(None)) -> list[str]:
        """Distinct pieces, by their number in the block."""
        return (self._distinct if isinstance(at, slice) else self._distinct.take(pa.array(at))).to_pylist()


def text_blocks(texts: Sequence[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) for blocks of whole texts; null is an empty text."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > limit:
            yield first, held
            held, size, first = [], 0, i
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def flattened(ids: list[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids one after the other, the number of each)."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    while len(a) < n:
        a = np.concatenate([a, np.zeros_like(a)])
    return a


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices begin, begin + 1, ... of spans of the given sizes, one after the other."""
    upto = np.cumsum(size)
    return np.repeat(begin - (upto - size), size) + np.arange(upto[-1] if len(size) else 0)


class Encoder:
    """Ids of whole texts, from a function that encodes distinct pieces.

    encode_new: of a list of pieces not seen before, (their order in the result, their ids one
    after the other, the number of ids of each).  Seen ones of at most ``KEPT_BYTES`` bytes stay in a table of at
    most ``keep`` pieces, which then starts anew: sorted 64-bit hashes lead to a piece's bytes, which are
    compared before its ids count.  A piece whose hash is another one's is encoded each time.
    special: strings that are one id wherever they occur.
    """

    KEPT_BYTES = 256

    def __init__(self, encode_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], special: dict[str, int] | None = None, keep: int = 600_000):
        self.encode_new, self.special, self.keep = encode_new, special or {}, keep
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of seen pieces
        self.slot = np.zeros(0, np.int32)  # and the number of each
        self.upto = np.zeros(1 << 16, np.int64)  # end of each number's ids in the pool
        self.pool = np.zeros(1 << 18, np.uint32)
        self.byte_upto = np.zeros(1 << 16, np.int64)  # and of its bytes
        self.bytes = np.zeros(1 << 18, np.uint8)

    def _encoded(self, block: Block, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces ``which``, in this order, the number of each)."""
        order, flat, sizes = self.encode_new(block.pieces(which))
        back = np.empty(len(which), np.int64)
        back[order] = np.arange(len(which))
        begin = np.cumsum(sizes) - sizes
        return flat[spans(begin[back], sizes[back])], sizes[back]

    def _learn(self, block: Block, hashes: np.ndarray, new: np.ndarray) -> None:
        flat, sizes = self._encoded(block, new)
        at, size = len(self.keys), block.end[new] - block.start[new]
        for held, values, ends, lengths in (("pool", flat, "upto", sizes), ("bytes", block.data[spans(block.start[new], size)], "byte_upto", size)):
            upto = _grown(getattr(self, ends), at + len(new) + 1)
            base = int(upto[at])
            upto[at + 1:at + 1 + len(new)] = base + np.cumsum(lengths)
            room = _grown(getattr(self, held), base + len(values))
            room[base:base + len(values)] = values
            setattr(self, ends, upto), setattr(self, held, room)
        keys = np.concatenate([self.keys, hashes[new]])
        sort = np.argsort(keys, kind="stable")  # a merge of two sorted runs, nearly
        self.slot = np.concatenate([self.slot, np.arange(at, at + len(new), dtype=np.int32)])[sort]
        self.keys = keys[sort]

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the piece that has each hash, whether there is one)."""
        if not len(self.keys):
            return np.zeros(len(hashes), np.int32), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return self.slot[at], self.keys[at] == hashes

    def _same(self, block: Block, number: np.ndarray) -> np.ndarray:
        """Whether the kept piece ``number`` has the bytes of each piece of the block."""
        size, begin = block.end - block.start, self.byte_upto[number]
        same = self.byte_upto[number + 1] - begin == size
        rest = np.flatnonzero(same)
        differ = self.bytes[spans(begin[rest], size[rest])] != block.data[spans(block.start[rest], size[rest])]
        if differ.any():
            same[rest[np.searchsorted(np.cumsum(size[rest]), np.flatnonzero(differ), "right")]] = False
        return same

    def _ids(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin of each distinct piece in them, number of ids of each)."""
        one, two = textscan.run_hashes(block.data, block.start, block.end)
        hashes = textscan.mix(one ^ (two * np.uint64(0x9E3779B97F4A7C15)))
        short = block.end - block.start <= self.KEPT_BYTES
        number, known = self._find(hashes)
        new = np.flatnonzero(short & ~known)
        if len(new) and len(self.keys) + len(new) > self.keep:
            self._reset()
            new = np.flatnonzero(short)
        if len(new):
            self._learn(block, hashes, np.sort(new[np.unique(hashes[new], return_index=True)[1]]))  # of equal hashes the first
            number, known = self._find(hashes)
        known &= short
        known &= self._same(block, np.where(known, number, 0))
        number = np.where(known, number, 0)
        begin, size = self.upto[number], self.upto[number + 1] - self.upto[number]
        odd = np.flatnonzero(~known)
        if not len(odd):
            return self.pool, begin, size
        flat, sizes = self._encoded(block, odd)
        used = int(self.upto[len(self.keys)])
        begin[odd], size[odd] = used + np.cumsum(sizes) - sizes, sizes
        return np.concatenate([self.pool[:used], flat]), begin, size

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text in them)."""
        if any(s in t for s in self.special for t in texts):
            return self._with_special(texts)
        b = Block(texts)
        pool, begin, size = self._ids(b)
        size = size[b.which]
        return pool[spans(begin[b.which], size)], np.concatenate([[0], np.cumsum(size)])[b.first]

    def _with_special(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, owner, after = [], [], []
        for i, t in enumerate(texts):
            rest = t
            while True:
                hits = [(rest.index(s), -len(s), s) for s in self.special if s in rest]
                if not hits:
                    parts.append(rest), owner.append(i), after.append(-1)
                    break
                at, size, s = min(hits)
                parts.append(rest[:at]), owner.append(i), after.append(self.special[s])
                rest = rest[at - size:]
        held, self.special = self.special, {}
        ids, offs = self.block(parts)
        self.special = held
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for k, i in enumerate(owner):
            out[i].append(ids[offs[k]:offs[k + 1]])
            if after[k] >= 0:
                out[i].append(np.array([after[k]], np.uint32))
        joined = [np.concatenate(x) for x in out]
        return np.concatenate(joined), np.concatenate([[0], np.cumsum([len(x) for x in joined])])

    def column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of an Arrow column, in order."""
        for _, held in text_blocks(texts.to_pylist()):
            ids, offs = self.block(held)
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                yield ids[a:b]
