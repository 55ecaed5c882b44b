"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

The windows of all test items (``n`` consecutive words; an item of fewer words is one window)
become sorted 64-bit hashes, shipped to every task as a broadcast.  Tasks hash the word windows of each
document in one pass, probe a bit table and then the sorted hashes, and compare every hit's
words with the item's own before it counts.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased.

Size: the broadcast holds flat arrays: the items' words once, and for each window its hash, its place in them
and its item.  ``WINDOW_BYTES`` for each byte of the items bounds all of it, so items whose text is over
``broadcast_bytes / WINDOW_BYTES`` are dealt into several blocks.  Each block has a pass of its own whose rows are written
before the next one begins: no two blocks are in memory at a time, no broadcast exceeds the limit (but
by an item that does so alone).

Edge cases: null or word-less texts have no words and no hits.  Items that are null, without words
or without an id have no windows.  Repeated items count once by id, repeated documents are judged
row by row.  Empty tables give empty results (no documents) or no hits (no items).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pieces, rows, textscan, workspace

N_WORDS = 10
BROADCAST_BYTES = 64 << 20
#: Built bytes of a byte of text, at most: a word of one letter and a blank become 38 (hash, places, item, the word).
WINDOW_BYTES = 20
BITS = 20

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FIELDS = [
    *workspace.long_fields("n_words", "n_hit", "n_items"),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("hit_spans", SPANS),
    T.StructField("contaminated", T.BooleanType()),
]


class TestSet:
    """Windows of the test items: for each window length, hashes in order, and what has them."""

    __test__ = False

    def __init__(self, items: Sequence[tuple[str, str]], n: int):
        self.names = [name for name, _ in items]
        texts = [text.encode() for _, text in items]
        raw = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        w = textscan.Words(raw, offsets, textscan.ALNUM)
        size = w.end - w.start  # words one after the other, each with a blank behind it
        end = np.cumsum(size + 1)
        self.start, self.end = end - size - 1, end - 1
        self.words = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
        self.words[pieces.spans(self.start, size)] = textscan.LOWER[raw[pieces.spans(w.start, size)]]
        first, last = w.first[:-1], w.first[1:]
        self.by_length = {}
        for k in np.unique(np.minimum(last - first, n)).tolist():
            own = np.flatnonzero(np.minimum(last - first, n) == k)
            if not k:
                continue
            count = last[own] - first[own] - k + 1
            at = pieces.spans(first[own], count)
            keys = textscan.windows(w.hash, k)[at]
            order = np.argsort(keys, kind="stable")
            bits = np.zeros(1 << BITS, bool)
            bits[(keys & np.uint64((1 << BITS) - 1)).astype(np.int64)] = True
            self.by_length[k] = (keys[order], bits, at[order], np.repeat(own, count)[order].astype(np.int32))

    def nbytes(self) -> int:
        arrays = [self.words, self.start, self.end, *(a for x in self.by_length.values() for a in x)]
        return sum(a.nbytes for a in arrays)

    def hits(self, w: textscan.Words) -> list[tuple[int, int, set[str]]]:
        """(first word, window length, items) of every verified occurrence, also such as cross texts."""
        out = []
        for k, (keys, bits, at, item) in self.by_length.items():
            g = textscan.windows(w.hash, k)
            maybe = np.flatnonzero(bits[(g & np.uint64((1 << BITS) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, g[maybe], "left"), np.searchsorted(keys, g[maybe], "right")
            for i, a, b in zip(maybe[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                window = b" ".join(w.text(j).lower() for j in range(i, i + k))
                own = {self.names[item[s]] for s in range(a, b) if self.words[self.start[at[s]]:self.end[at[s] + k - 1]].tobytes() == window}
                if own:
                    out.append((i, k, own))
        return out


def _find(text: pa.Array, tests: TestSet) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    n = len(text)
    count, spans, found = np.zeros(n, np.int64), [[] for _ in range(n)], [set() for _ in range(n)]
    for a, b, w in textscan.scan(text, textscan.ALNUM):
        count[a:b] = np.diff(w.first)
        hits = tests.hits(w)
        docs = np.searchsorted(w.first, [i for i, _, _ in hits], side="right") - 1 if hits else []
        for (i, k, items), d in zip(hits, np.asarray(docs).tolist(), strict=True):
            if i + k <= w.first[d + 1]:
                at = i - int(w.first[d])
                spans[a + d].append((at, at + k))
                found[a + d] |= items
    return count, spans, found


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def scan_documents(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with FIELDS: counts, sorted ids of occurring items, word spans [start, end) hit."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text")).where("item is not null and text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text") + 1).alias("n")).first()["n"] or 0
    parts = -(-total * WINDOW_BYTES // broadcast_bytes) or 1
    out = docs
    for k in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        tests = spark.sparkContext.broadcast(TestSet([(r["item"], r["text"]) for r in part.toLocalIterator()], n))

        def one(column: pa.Array, held=tests) -> list[pa.Array]:
            count, spans, found = _find(column, held.value)
            return [pa.array(count), *_columns(count, [_union(s) for s in spans], found)]

        out = rows.extend(out, text, FIELDS if parts == 1 else [T.StructField(f"{f.name}__{k}", f.dataType) for f in FIELDS], one)
        if k < parts - 1:
            out = workspace.written(out, "decontaminated")
    return out if parts == 1 else _merged(out, parts)


def _columns(count: np.ndarray, spans: list[list[tuple[int, int]]], found: list[set[str]]) -> list[pa.Array]:
    n_hit = pa.array([sum(e - s for s, e in x) for x in spans], pa.int64())
    ids = pa.array([sorted(x) for x in found], pa.list_(pa.string()))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return [n_hit, pa.array([len(x) for x in found], pa.int64()), ids, pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], kind), pa.array([bool(x) for x in found], pa.bool_())]


def _merged(df: DataFrame, parts: int) -> DataFrame:
    """One set of FIELDS from those of several passes."""
    names = [f.name for f in FIELDS]
    own = [c for c in df.columns if not any(c == f"{n}__{k}" for n in names for k in range(parts)) and c.lower() not in names]
    ids = F.array_sort(F.array_distinct(F.flatten(F.array(*[f"item_ids__{k}" for k in range(parts)]))))
    words = F.array_sort(F.array_distinct(F.flatten(F.transform(F.flatten(F.array(*[f"hit_spans__{k}" for k in range(parts)])), lambda s: F.sequence(s["start"], s["end"] - 1)))))
    df = df.withColumns({"__ids": ids, "__hit": F.coalesce(words, F.array().cast("array<int>"))})
    starts = F.filter("__hit", lambda w, i: ~F.array_contains(F.col("__hit"), w - 1))
    ends = F.filter("__hit", lambda w, i: ~F.array_contains(F.col("__hit"), w + 1))
    spans = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e + 1).alias("end")))
    return df.select(*[F.col(f"`{c}`") for c in own], F.col("n_words__0").alias("n_words"), F.size("__hit").cast("long").alias("n_hit"), F.size("__ids").cast("long").alias("n_items"), F.col("__ids").alias("item_ids"), spans.alias("hit_spans"), (F.size("__ids") > 0).alias("contaminated"))


def _cut(column: pa.Array, spans: pa.Array) -> pa.Array:
    out = column.to_pylist()
    cuts = spans.to_pylist()
    for a, b, w in textscan.scan(column, textscan.ALNUM):
        for d in range(a, b):
            if not cuts[d]:
                continue
            parts, at = [], int(w.offsets[d - a])
            first = int(w.first[d - a])
            for s in cuts[d]:
                parts.append(w.data[at:w.start[first + s["start"]]].tobytes())
                at = int(w.end[first + s["end"] - 1])
            parts.append(w.data[at:w.offsets[d - a + 1]].tobytes())
            out[d] = b"".join(parts).decode("utf-8", "replace")
    return pa.array(out, pa.string())


def remove(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", action: str = "documents", **options) -> DataFrame:
    """Documents without contamination: drop hit documents, or cut the hit spans out of them.

    action: ``documents`` drops every document with a hit; ``spans`` keeps all of them and removes
    the words of each hit span with what stands between these words.  Columns are those of ``docs``.
    """
    if action not in ("documents", "spans"):
        raise ValueError(f"action {action!r} is neither 'documents' nor 'spans'")
    marked = scan_documents(docs, benchmark, text=text, **options)
    own = [c for c in docs.columns if c in marked.columns and c not in {f.name for f in FIELDS}]
    if action == "documents":
        return marked.where(~F.col("contaminated")).select(*[F.col(f"`{c}`") for c in own])
    names = marked.columns
    at, cut = names.index(text), names.index("hit_spans")

    def run(batches):
        for x in batches:
            arrays = [_cut(x.column(i), x.column(cut)) if i == at else x.column(i) for i in range(x.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return marked.mapInArrow(run, marked.schema).select(*[F.col(f"`{c}`") for c in own])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document of the table against every benchmark item."""
    docs = workspace.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan_documents(docs, workspace.table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def digest_of(items: Sequence[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, list_aggregate(w[i:i + least(len(w), 10) - 1], 'string_agg', ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS r(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT rid, i, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS g
  FROM d, ks, unnest(range(1, len(w) - k + 2)) AS r(i) WHERE len(w) >= k),
h AS (SELECT dw.rid, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
p AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM h, unnest(range(i, i + k)) AS r(pos) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
       coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN t USING (rid)
"""
