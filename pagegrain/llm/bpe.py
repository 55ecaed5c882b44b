"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

1. Pieces (words of the pre-tokeniser) are counted over all documents; each task adds up its own and
   hands on those with at least one in ``RARE`` of its pieces, so what it emits is bounded.
2. The most frequent ``LEXICON`` pieces of at most ``ENTRY_BYTES`` bytes become a minimal acyclic automaton: states
   with equal futures are shared, arcs carry numbers whose sum along a word is the word's rank in the
   lexicon, and a table leads from the rank to the ids.  Its arrays are one byte string, broadcast
   (``LEXICON * ENTRY_BYTES`` arcs at most) and mapped read-only by each Python worker, as an anonymous file of its own.
3. A worker looks up all distinct pieces of a block at once, one arc per step.  Pieces that the
   automaton does not accept are merged exactly, by the vocabulary's merge ranks.

The lexicon only saves time: with any lexicon, also an empty one, the ids are the same.

Ids are those of the tokenizers library for a byte-level BPE file (no normaliser, prefix space,
padding or truncation), also for special tokens whose strings occur in a text.

Edge cases: null and empty texts have no ids and decode to an empty string.  Text of any length is
encoded whole; pieces of thousands of characters merge in O(n log n), each time they occur in another block.  Repeated rows stay; input columns
that have a result's name are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pieces, rows, textscan, workspace

LEXICON = 32_768
ENTRY_BYTES = 64
RARE = 50_000
LONG_PIECE = 48


def byte_alphabet() -> list[str]:
    """Visible character of each byte: printable ones stand for themselves, the rest from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Vocabulary:
    """Merges and token bytes of a byte-level BPE file."""

    def __init__(self, spec: str):
        found = json.loads(spec)
        model, ids = found["model"], found["model"]["vocab"]
        letter = byte_alphabet()
        byte = {c: i for i, c in enumerate(letter)}
        self.of_byte = [ids[c] for c in letter]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.special = {x["content"]: x["id"] for x in found["added_tokens"]}
        table: dict[int, bytes] = {i: bytes(byte[c] for c in t) for t, i in ids.items()}
        table |= {i: t.encode() for t, i in self.special.items()}
        parts = [table.get(i, b"") for i in range(max(table) + 1)]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one piece: always the pair of the lowest rank, the leftmost of equals."""
        ids, merges = [self.of_byte[b] for b in word], self.merges
        if len(ids) > LONG_PIECE:
            return self._merge_long(ids)
        while len(ids) > 1:
            best, at, new = 1 << 30, -1, -1
            for i, pair in enumerate(zip(ids, ids[1:])):  # noqa: B905
                m = merges.get(pair)
                if m and m[0] < best:
                    best, new, at = m[0], m[1], i
            if at < 0:
                break
            ids[at:at + 2] = [new]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(m[0], i, a, b, m[1]) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (m := self.merges.get((a, b)))]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
        return [t for t, ok in zip(ids, alive, strict=True) if ok]

    def decode(self, ids: np.ndarray) -> str:
        size = self.sizes[ids]
        upto = np.cumsum(size)
        take = np.repeat(self.begins[ids] - (upto - size), size) + np.arange(upto[-1] if len(ids) else 0)
        return self.bytes[take].tobytes().decode("utf-8", "replace")


def compile_lexicon(words: Iterable[bytes], ids_of) -> bytes:
    """Serialised minimal acyclic transducer of distinct words; ids_of: ids of a word.

    Words come in sorted order; a state is closed, and replaced by an equal one if there is such,
    as soon as the next word leaves it.
    """
    words = sorted(set(words))
    final, arcs, number = [False], [{}], {}

    def close(path: list[tuple[int, int]], down_to: int) -> None:
        while len(path) > down_to:
            state, byte = path.pop()
            child = arcs[state][byte]
            key = (final[child], tuple(arcs[child].items()))
            arcs[state][byte] = number.setdefault(key, child)

    path: list[tuple[int, int]] = []
    last = b""
    for w in words:
        common = next((i for i, (a, b) in enumerate(zip(w, last)) if a != b), min(len(w), len(last)))  # noqa: B905
        close(path, common)
        state = arcs[path[-1][0]][path[-1][1]] if path else 0
        for byte in w[common:]:
            final.append(False), arcs.append({})
            arcs[state][byte] = len(arcs) - 1
            path.append((state, byte))
            state = len(arcs) - 1
        final[state] = True
        last = w
    close(path, 0)
    count: dict[int, int] = {}
    order, stack = [], [0]
    while stack:  # states after all that they lead to
        s = stack.pop()
        if s in count:
            continue
        todo = [c for c in arcs[s].values() if c not in count]
        if todo:
            stack += [s, *todo]
            continue
        count[s] = final[s] + sum(count[c] for c in arcs[s].values())
        order.append(s)
    place = {s: i for i, s in enumerate(reversed(order))}
    key, to, add = [], [], []
    for s in reversed(order):
        before = int(final[s])
        for byte, c in arcs[s].items():
            key.append(place[s] << 8 | byte), to.append(place[c]), add.append(before)
            before += count[c]
    ids = [ids_of(w) for w in words]
    ends = np.cumsum([len(x) for x in ids], dtype=np.uint32) if ids else np.zeros(0, np.uint32)
    by = np.argsort(np.array(key, np.uint32), kind="stable")
    arrays = [np.array(x, np.uint32)[by] for x in (key, to, add)] + [np.array([final[s] for s in reversed(order)], np.uint32), np.concatenate([[0], ends]).astype(np.uint32), np.array([i for x in ids for i in x], np.uint32)]
    head = np.array([len(a) for a in arrays] + [max(map(len, words), default=0)], np.uint32)
    return head.tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """The transducer over memory-mapped arrays."""

    def __init__(self, data: bytes):
        if hasattr(os, "memfd_create"):  # a mapped file that is in no folder
            fd = os.memfd_create("lexicon")
            os.write(fd, data)
            self.map = mmap.mmap(fd, len(data), prot=mmap.PROT_READ)
            os.close(fd)
        else:
            self.map = mmap.mmap(-1, len(data))
            self.map.write(data)
        *sizes, self.longest = np.frombuffer(self.map, np.uint32, 7).tolist()
        at, arrays = 28, []
        for n in sizes:
            arrays.append(np.frombuffer(self.map, np.uint32, n, at))
            at += 4 * n
        self.key, self.to, self.add, self.final, self.upto, self.ids = arrays

    def find(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word in the lexicon, or -1."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        rank = np.full(n, -1, np.int64)
        if not len(self.key):
            return rank
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        on = np.flatnonzero(size <= self.longest)
        state, total = np.zeros(len(on), np.int64), np.zeros(len(on), np.int64)
        for k in range(self.longest + 1):
            done = size[on] == k
            if done.any():
                ok = done & (self.final[state] == 1)
                rank[on[ok]] = total[ok]
                on, state, total = on[~done], state[~done], total[~done]
            if not len(on):
                break
            want = (state << 8) | data[begin[on] + k]
            arc = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            live = self.key[arc] == want
            on, arc = on[live], arc[live]
            state, total = self.to[arc].astype(np.int64), total[live] + self.add[arc]
        return rank


def encoder(vocabulary: Vocabulary, lexicon: Lexicon | None) -> pieces.Encoder:
    def encode_new(new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = [p.encode("utf-8", "surrogatepass") for p in new]
        rank = lexicon.find(words) if lexicon else np.full(len(words), -1)
        ids = [vocabulary.merge(w) if r < 0 else lexicon.ids[lexicon.upto[r]:lexicon.upto[r + 1]].tolist() for w, r in zip(words, rank.tolist(), strict=True)]
        return np.arange(len(new)), *pieces.flattened(ids)

    return pieces.Encoder(encode_new, vocabulary.special)


_WORKER: dict[tuple[str, bytes], tuple[Vocabulary, pieces.Encoder]] = workspace.kept("bpe")


def worker_encoder(spec: str, lexicon: bytes) -> tuple[Vocabulary, pieces.Encoder]:
    """Vocabulary and encoder of this Python worker: later tasks find the pieces of earlier ones."""
    if (spec, lexicon) not in _WORKER:
        _WORKER.clear()
        own = Vocabulary(spec)
        _WORKER[spec, lexicon] = own, encoder(own, Lexicon(lexicon))
    return _WORKER[spec, lexicon]


def frequent_pieces(docs: DataFrame, text: str = "text", limit: int = LEXICON) -> list[str]:
    """The most frequent pieces of at most ``ENTRY_BYTES`` bytes of all documents, most frequent first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, floor = Counter(), 0, 1
        for x in batches:
            for _, texts in (b for s in textscan.slices(x, 0) for b in pieces.text_blocks(s.column(0).to_pylist())):
                b = pieces.Block(texts)
                total += len(b.which)
                short = np.flatnonzero(b.end - b.start <= ENTRY_BYTES)
                seen.update(dict(zip(b.pieces(short), np.bincount(b.which, minlength=len(b))[short].tolist(), strict=True)))
                while len(seen) > 8 * RARE:  # rare ones go; a piece over 1 in RARE cannot fall under
                    floor += 1
                    seen = Counter({w: c for w, c in seen.items() if c >= floor})
        kept = [(w, c) for w, c in seen.items() if c >= max(2, total // RARE)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([c for _, c in kept], pa.int64())], names=["piece", "n"])

    counted = workspace.in_arrow(docs.select(F.col(f"`{text}`").cast("string").alias("text")), count, "piece string, n long")
    top = counted.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(limit)
    return [r["piece"] for r in top.collect()]


FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
FULL = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]


def transcode(docs: DataFrame, *, text: str = "text", tokenizer: str, lexicon: int = LEXICON, full: bool = False) -> DataFrame:
    """``docs`` with FIELDS (or, with full, the ids and the decoded text); tokenizer: a file's content."""
    sc = docs.sparkSession.sparkContext
    vocabulary = Vocabulary(tokenizer)
    words = [p.encode() for p in frequent_pieces(docs, text, lexicon)] if lexicon else []
    held = sc.broadcast((tokenizer, compile_lexicon(words, vocabulary.merge)))

    def work(column: pa.Array) -> list[pa.Array]:
        own, encode = worker_encoder(*held.value)
        sizes, first, second = [], [], []
        for ids in encode.column(column):
            back = own.decode(ids)
            sizes.append(len(ids))
            first.append(ids.astype(np.int32) if full else hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            second.append(back if full else hashlib.sha256(back.encode()).hexdigest())
        if full:
            return [pa.array(first, pa.list_(pa.int32())), pa.array(second, pa.string())]
        return [pa.array(sizes, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]

    return rows.extend(docs, text, FULL if full else FIELDS, work, owner="bpe")


def public_spec() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: encode and decode all documents."""
    docs = workspace.table(spark, sf_dir, "documents").select("doc_id", "text")
    return transcode(docs, tokenizer=public_spec()).select("doc_id", *[f.name for f in FIELDS])
