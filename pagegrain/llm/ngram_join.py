"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, exact sorted-array intersection.

Two documents are linked when the Jaccard similarity of their sets of word n-grams is at least
``num / den``.  The result is exact: one row per document with the smallest id it is linked to,
directly or through others.

1. Sets.  Each text becomes a sorted array of distinct 64-bit n-gram hashes, made of 128-bit hashes of its words.
   Texts with equal sets are one *class* (128-bit digest of the set), so exact copies, however many, cost one entry.
2. Tiles.  A linked pair must share one of the first ``n - ceil(t n) + 1`` n-grams of both sets in any fixed
   order.  The order here is by hash, with n-grams frequent in the corpus last.  A tile is such an n-gram and a size
   band: sets of one power of two, and those a little smaller that can still reach it.  Tiles
   with one set are dropped.  Tiles of a band that have the same smallest member (its key is a hash, so this is a
   min-hash of the tile) are one group: near copies share most of their tiles, but a set's bitmap
   travels once for each group it is in, not once for each n-gram.  Groups over ``BLOCK`` sets or ``BLOCK_GRAMS``
   n-grams are dealt into pairs of blocks.
3. Bitmaps.  In a group, ``n_x - popcount(x & ~y)`` bounds the overlap from above; pairs whose bound is too small
   are no candidates.  Only a spanning forest of the candidates leaves a task.
4. Candidate components are joined to their texts (each text travels once, or once per block of a very large
   component) and verified: exact intersections of sorted arrays, visiting each set once per
   connected component found.  The arrays hold numbers that stand for the n-grams' words themselves, so no hash
   takes part in this decision.  Verified links make the final components.

Pairs of one group are never all emitted: a set that is found connected is not compared again.  Broadcast: the frequent
n-grams, at most ``MAX_FREQUENT`` (they change the order of n-grams, never the result), and the ids of the candidates' texts
while there are at most ``BROADCAST_IDS`` (64 MB): beyond that all texts pass the join's shuffle.

Hashes: equal n-grams have equal hashes, so no link is lost by them.  Set sizes and classes would be wrong only for two
n-grams of one text, or two sets, with equal hashes of 64 or 128 bits; ``seed`` chooses other hashes.

Limit: within one family of linked, pairwise different texts of more than ``BLOCK_TOKENS`` n-grams, blocks
are compared pair by pair.

Edge cases: null, empty and word-less texts have no n-grams, are linked with nothing and are a component of their own;
fewer than n words are one n-gram.  A repeated id is a row of its own; rows without an id link like others, and a
component without any id has none.  Two different sets of one 64-bit
class key (to be expected beyond some 10^9 different texts) raise an error that asks for another seed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan, workspace

N_WORDS = 4
NUM, DEN = 85, 100
BLOCK = 2048
BLOCK_GRAMS = 1 << 25
BLOCK_TOKENS = 500_000
BROADCAST_IDS = 4_000_000
BROADCAST_DROPS = 2_000_000
SALTS = 16
MAX_FREQUENT = 200_000
FREQUENT_PER = 2000
LONG = 4096
WIDE_BITS = 1 << 17


def _per_text(w: textscan.Words, k: int, grams: np.ndarray, short) -> Iterator[np.ndarray]:
    """Sorted distinct n-grams of each text; short: that of a text of fewer words, from its first and last."""
    first = w.first.tolist()
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= k:
            yield np.unique(grams[lo:hi - k + 1])
        else:
            yield short(lo, hi) if hi > lo else grams[:0]


def hashed_sets(w: textscan.Words, k: int, seed: int) -> Iterator[np.ndarray]:
    one, two = w.wide(seed)
    return _per_text(w, k, textscan.windows(one, k, two), lambda lo, hi: textscan.windows(one[lo:hi], hi - lo, two[lo:hi]))


def exact_sets(w: textscan.Words, k: int) -> Iterator[np.ndarray]:
    """Sets of numbers that only equal n-grams share.  A text of fewer than k words shares its only one with no other class."""
    return _per_text(w, k, textscan.exact_windows(w.number, k).astype(np.uint64), lambda lo, hi: np.array([(1 << 63) + lo], np.uint64))


def doc_sets(column: pa.Array, k: int, seed: int = 0) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    for _, _, w in textscan.scan(column, textscan.NON_SPACE):
        yield from hashed_sets(w, k, seed)


def digest(tokens: np.ndarray, seed: int) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(tokens.tobytes(), seed)
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _bits(tokens: np.ndarray, width: int) -> bytes:
    bits = np.zeros(width, bool)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _width(n: int) -> int:
    return max(64, 1 << (n - 1).bit_length())


def bitmap(tokens: np.ndarray, num: int, den: int) -> bytes:
    """Bits of the hashes' low parts, with a width of the next power of two of ``n / t``.

    So all maps in a tile have at least as many bits as its largest set has n-grams.  Sets of ``LONG`` n-grams or
    more map half of these only (those with a zero in one hash bit) at half the width: their bound is
    still sharp.  Sets that meet both kinds have both maps, the whole and then the half.
    """
    n = len(tokens)
    reach = -(-n * den // num)
    whole = _bits(tokens, _width(reach)) if n < LONG else b""
    if den * n < num * LONG:
        return whole
    return whole + _bits(tokens[(tokens >> np.uint64(40)) & np.uint64(1) == 0], _width(reach) // 2)


def wide_bitmap(tokens: np.ndarray) -> bytes:
    """A whole map for the comparison of few sets."""
    return _bits(tokens, min(WIDE_BITS, _width(len(tokens))))


def tile_maps(maps: list[bytes], n: np.ndarray, num: int, den: int) -> list[bytes]:
    """The maps of one kind that all sets of a tile have."""
    half = bool(max(n) >= LONG)
    both = (den * n >= num * LONG) & (n < LONG)
    return [(m[2 * len(m) // 3:] if half else m[:2 * len(m) // 3]) if b else m for m, b in zip(maps, both.tolist(), strict=True)]


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, folded to the smallest width among them."""
    width = min(map(len, maps))
    out = np.empty((len(maps), width // 8), np.uint64)
    for i, m in enumerate(maps):
        row = np.frombuffer(m, np.uint64)
        out[i] = row if len(m) == width else np.bitwise_or.reduce(row.reshape(-1, width // 8), axis=0)
    return out


class Forest:
    """Union-find over node keys."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.setdefault(root, root)) != root:
            root = p
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> pa.RecordBatch:
        pairs = [(x, self.find(x)) for x in list(self.up)]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def connect(forest: Forest, nodes: list[int], linked) -> None:
    """Unite linked nodes of a group; linked(i, others): which of ``others`` node i is linked to.

    Breadth first: whoever is found leaves the rest, so a group that hangs together costs a
    comparison per node.  Nodes that the forest already has together count as found.
    """
    root = np.array([forest.find(x) for x in nodes])
    rest = np.arange(len(nodes))
    while len(rest):
        same = root[rest] == root[rest[0]]
        queue, rest = rest[same].tolist(), rest[~same]
        while queue and len(rest):
            i = queue.pop()
            hit = linked(i, rest)
            if not hit.any():
                continue
            found = rest[hit]
            for j in found:
                forest.union(nodes[i], nodes[j])
            more = np.isin(root[rest], root[found])  # with all that hang together with them
            queue += rest[more].tolist()
            rest = rest[~more]


def _stream(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[pa.Array]]:
    """Groups of equal values in the first ``key`` columns of sorted batches, as sliced columns."""
    held: list[pa.RecordBatch] = []
    for x in batches:
        if not len(x):
            continue
        keys = [x.column(i).to_numpy() for i in range(key)]
        new = np.zeros(len(x), bool)
        for c in keys:
            new[1:] |= c[1:] != c[:-1]
        if held and any(held[-1].column(i)[-1].as_py() != x.column(i)[0].as_py() for i in range(key)):
            yield _whole(held)
            held = []
        cuts = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield _whole([*held, x.slice(a, b - a)])
            held = []
        held.append(x.slice(cuts[-1]))
    if held:
        yield _whole(held)


def _whole(parts: list[pa.RecordBatch]) -> list[pa.Array]:
    if len(parts) == 1:
        return parts[0].columns
    return [c.combine_chunks() for c in pa.Table.from_batches(parts).columns]


def frequent_ngrams(docs: DataFrame, k: int, seed: int) -> np.ndarray:
    """Hashes of n-grams that are in more than 1 of ``FREQUENT_PER`` texts, as far as tasks of their own see."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        seen: dict[int, int] = {}

        def flush() -> None:
            token, times = np.unique(np.concatenate(held), return_counts=True)
            hot = times >= max(8, len(held) // FREQUENT_PER)
            for t, c in zip(token[hot].view(np.int64).tolist(), times[hot].tolist(), strict=True):
                seen[t] = seen.get(t, 0) + c
            held.clear()

        for x in batches:
            for s in textscan.slices(x, 0):
                for tokens in doc_sets(s.column(0), k, seed):
                    held.append(tokens)
                    size += len(tokens)
                    if size > 2_000_000:
                        flush()
                        size = 0
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["token", "times"])

    found = workspace.in_arrow(docs, count, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    top = found.orderBy(F.desc("times"), "token").limit(MAX_FREQUENT)
    return np.sort(np.array([r["token"] for r in top.collect()], np.int64).view(np.uint64))


def class_rows(docs: DataFrame, k: int, num: int, den: int, frequent: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, n, node, node_check, bits, prefix) of each document and the other columns; node is null without n-grams."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)
    carried = docs.drop("doc_id", "text").schema.fields
    names = ["doc_id", "n", "node", "node_check", "bits", "prefix", *[f.name for f in carried]]
    schema = T.StructType([*workspace.long_fields(*names[:4]), T.StructField("bits", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType())), *carried])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = held.value
        table = np.zeros(1 << 22, bool)
        table[(last & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        for x in (s for whole in batches for s in textscan.slices(whole, 1)):
            cols: list[list] = [[], [], [], [], []]
            for tokens in doc_sets(x.column(1), k, seed):
                n = len(tokens)
                if not n:
                    for c, v in zip(cols, (0, None, None, None, None), strict=True):
                        c.append(v)
                    continue
                back = table[(tokens & np.uint64((1 << 22) - 1)).astype(np.int64)]
                if back.any():
                    some = tokens[back]
                    back[back] = last[np.minimum(np.searchsorted(last, some), len(last) - 1)] == some
                    order = np.concatenate([tokens[~back], tokens[back]])
                else:
                    order = tokens
                node, check = digest(tokens, seed)
                for c, v in zip(cols, (n, node, check, bitmap(tokens, num, den), order[:n - -(-num * n // den) + 1].view(np.int64)), strict=True):
                    c.append(v)
            made = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(0), *made, *x.columns[2:]], names=names)

    return workspace.in_arrow(docs, run, schema)


def classes_of(sets: DataFrame) -> DataFrame:
    """One row per class of equal sets: node, n, first_id, bits, prefix."""
    one = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("node_check").alias("lo"), F.max("node_check").alias("hi"), F.any_value("n").alias("n"), F.any_value("bits").alias("bits"), F.any_value("prefix").alias("prefix"))
    same = F.when(F.col("lo") == F.col("hi"), F.col("node")).otherwise(F.raise_error(F.lit("two sets have one class key; use another seed")).cast("long"))
    return one.select(same.alias("node"), "n", "first_id", "bits", "prefix")


def _block_pairs(blocks: Column, node: str = "node") -> Column:
    """The pairs (i, j) of blocks that a member of a group takes part in: one if the group has one block only."""
    mine = F.pmod(F.xxhash64(node), blocks.cast("long")).cast("int")
    dealt = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j")))
    return F.when(blocks == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(dealt)


def tile_groups(classes: DataFrame, num: int, den: int) -> DataFrame:
    """(band, centre, i, j, node): who is compared with whom, each once.  No set's bitmap takes part yet."""
    band = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    upper = F.when(den * F.col("n") >= F.lit(num) * F.pow(F.lit(2.0), band + 1), F.array(band, band + 1)).otherwise(F.array(band))
    posts = classes.select("node", F.explode("prefix").alias("token"), upper.alias("bands")).select("node", "token", F.explode("bands").alias("band"))
    posts = posts.select("node", F.xxhash64("token", "band").alias("tile"), "band")  # two tiles of one hash only compare more
    tiles = posts.groupBy("tile").agg(F.count(F.lit(1)).alias("sets"), F.min("node").alias("centre"), F.any_value("band").alias("band")).where("sets > 1").drop("sets")
    member = workspace.written(posts.drop("band").join(tiles.hint("merge"), "tile").select("band", "centre", "node").distinct(), "ngram-groups")
    blocks = F.ceil(F.greatest(F.col("sets") / BLOCK, F.col("sets") * F.pow(F.lit(2.0), F.col("band") + 1) / BLOCK_GRAMS)).cast("int")
    large = member.groupBy("band", "centre").agg(F.count(F.lit(1)).alias("sets")).select("band", "centre", blocks.alias("blocks")).where("blocks > 1")
    dealt = member.join(large, ["band", "centre"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return dealt.select("band", "centre", F.explode(_block_pairs(F.col("blocks"))).alias("p"), "node").select("band", "centre", "p.i", "p.j", "node")


def candidate_edges(classes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): a forest over class nodes that has every linked pair in one tree."""
    groups = tile_groups(classes, num, den).join(classes.select("node", "n", "bits"), "node").select("band", "centre", "i", "j", "node", "n", "bits")
    tiles = groups.repartition("band", "centre", "i", "j").sortWithinPartitions("band", "centre", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for cols in _stream(batches, 4):
            nodes = cols[4].to_pylist()
            if len(nodes) < 2 or (len(nodes) == 2 and forest.find(nodes[0]) == forest.find(nodes[1])):
                continue
            n = cols[5].to_numpy().astype(np.int64)
            if len(nodes) == 2 and num * max(n) > den * min(n):
                continue
            rows = folded(tile_maps(cols[6].to_pylist(), n, num, den))
            ones = np.bitwise_count(rows).sum(axis=1).astype(np.int64)

            def linked(i: int, rest: np.ndarray, rows=rows, ones=ones, n=n) -> np.ndarray:
                common = np.bitwise_count(rows[rest] & rows[i]).sum(axis=1).astype(np.int64)
                bound = np.minimum(n[i] - ones[i] + common, n[rest] - ones[rest] + common)
                return (num + den) * bound >= num * (n[i] + n[rest])

            connect(forest, nodes, linked)
            if len(forest.up) > 500_000:
                yield forest.edges()
                forest = Forest()
        yield forest.edges()

    return workspace.in_arrow(tiles, run, "a long, b long")


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for all nodes of (a, b); root is the smallest node that can be reached.

    Alternating large-star and small-star steps: neighbours are hung on the smallest known node,
    until nothing moves.  Each round is written, so lineage stays short.
    """
    e = workspace.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{label}-edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct()
        e = workspace.written(small, f"{label}-round")
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if state == now:
            return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now


def _texts_without_id(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """(node, text) of the classes that have rows with a null doc_id, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (s for whole in batches for s in textscan.slices(whole, 0)):
            nodes = [digest(tokens, seed)[0] if len(tokens) else None for tokens in doc_sets(x.column(0), k, seed)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), x.column(0).cast(pa.string())], names=["node", "text"])

    found = workspace.in_arrow(docs.where("doc_id is null").select("text"), run, "node long, text string")
    return found.where("node is not null").dropDuplicates(["node"])


def verified_edges(docs: DataFrame, classes: DataFrame, trees: DataFrame, k: int, num: int, den: int, seed: int) -> DataFrame:
    """(a, b): a forest of the pairs that are linked indeed, within the candidate components."""
    member = trees.join(classes.select("node", "n", "first_id"), "node")
    load = member.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks"))
    wanted = workspace.written(member.join(load, "root").select("root", "node", "first_id", _block_pairs(F.col("blocks")).alias("pairs")), "ngram-wanted")
    asked = docs
    if wanted.count() <= BROADCAST_IDS:  # only texts of candidates pass the shuffle
        asked = docs.join(F.broadcast(wanted.select(F.col("first_id").alias("doc_id")).distinct()), "doc_id", "left_semi")
    texts = asked.join(wanted, asked["doc_id"] == wanted["first_id"]).select("root", F.explode("pairs").alias("p"), "node", "text")
    nameless = _texts_without_id(docs, k, seed).join(wanted.where("first_id is null"), "node").select("root", F.explode("pairs").alias("p"), "node", "text")
    texts = texts.unionByName(nameless)
    placed = texts.select("root", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "node", "text").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for cols in _stream(batches, 3):
            raw, offs = textscan.string_buffers(cols[4])
            w = textscan.Words(raw[offs[0]:offs[-1]], offs - offs[0], textscan.NON_SPACE)
            sets: dict[int, np.ndarray] = {}
            for node, hashed, exact in zip(cols[3].to_pylist(), hashed_sets(w, k, seed), exact_sets(w, k), strict=True):
                if node not in sets and digest(hashed, seed)[0] == node:  # an id may have other texts as well
                    sets[node] = exact
            nodes, arrays = list(sets), list(sets.values())
            if len(nodes) < 2:
                continue
            n = np.array([len(a) for a in arrays])
            rows = folded([wide_bitmap(a) for a in arrays])
            ones = np.bitwise_count(rows).sum(axis=1).astype(np.int64)

            def linked(i: int, rest: np.ndarray, rows=rows, ones=ones, n=n, arrays=arrays) -> np.ndarray:
                common = np.bitwise_count(rows[rest] & rows[i]).sum(axis=1).astype(np.int64)
                out = (num + den) * np.minimum(n[i] - ones[i] + common, n[rest] - ones[rest] + common) >= num * (n[i] + n[rest])
                near = np.flatnonzero(out)
                for a in range(0, len(near), 256):  # exact overlap of one sorted array with many
                    at = near[a:a + 256]
                    flat = np.concatenate([arrays[j] for j in rest[at]])
                    slot = np.minimum(np.searchsorted(arrays[i], flat), n[i] - 1)
                    upto = np.concatenate([[0], np.cumsum(arrays[i][slot] == flat)])
                    ends = np.cumsum(n[rest[at]])
                    overlap = upto[ends] - upto[ends - n[rest[at]]]
                    out[at] = den * overlap >= num * (n[i] + n[rest[at]] - overlap)
                return out

            connect(forest, nodes, linked)
            if len(forest.up) > 500_000:
                yield forest.edges()
                forest = Forest()
        yield forest.edges()

    return workspace.in_arrow(placed, run, "a long, b long")


def join_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = N_WORDS, num: int = NUM, den: int = DEN, seed: int = 0, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    carry: other columns to have in the result, with ``component``: a key of the component that is there without an
    id, too (null without n-grams).  They must not be named like the columns inside.
    """
    if not den <= 2 * num <= 2 * den:
        raise ValueError("similarities from 0.5 to 1 only: size bands reach no further")
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), *carry)
    frequent = frequent_ngrams(docs.select("text"), k, seed)
    sets = workspace.written(class_rows(docs, k, num, den, frequent, seed), "ngram-sets")
    classes = workspace.written(classes_of(sets), "ngram-classes")
    trees = workspace.written(components(candidate_edges(classes, num, den), "ngram-candidates"), "ngram-trees")
    links = components(verified_edges(docs.select("doc_id", "text"), classes, trees, k, num, den, seed), "ngram-links")
    rooted = classes.select("node", "first_id").join(links, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    rooted = workspace.written(rooted, "ngram-rooted")
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(lowest, "root").select("node", "component_id", F.col("root").alias("component"))
    more = [*carry, "component"] if carry else []
    return sets.select("doc_id", "n", "node", *carry).join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *more)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest id stays.

    Rows are told apart by (doc_id, text): other texts of a repeated id stay, rows without an id yield to those with one,
    equal ids to the smaller digest of the text, and of rows equal in both one stays.  Texts without n-grams all stay.  ``options``: as for join_components.

    The rows to drop are broadcast while there are at most ``BROADCAST_DROPS`` (some 100 bytes each, 200 MB); beyond that
    the rows pass one shuffle by id and digest.  A component's decision is dealt ``SALTS`` times, so a large one is no single task.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    digest_of = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    keyed = docs.select(F.struct(*own).alias("__row"), F.col("doc_id").cast("long").alias("__id"), digest_of.alias("__key"), F.col("text").alias("__text"))
    found = join_components(keyed, doc_id="__id", text="__text", carry=["__key"], **options).where("component is not null")
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.col("__key").alias("key"))
    best = found.groupBy("component").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1")
    best = best.select("component", "best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = found.groupBy("component", F.col("doc_id").alias("id"), F.col("__key").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    place = F.xxhash64("id", "key")  # spreads rows; id and digest decide
    rows = rows.select("*", place.alias("place")).withColumn("salt", F.pmod("place", F.lit(SALTS)).cast("int"))
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("key") == F.col("best.key"))
    judged = rows.join(best, ["component", "salt"]).select("place", "id", "key", "n", stays.alias("stays")).where("n > 1 or not stays")
    judged = workspace.written(judged, "ngram-drops")
    small = judged.count() <= BROADCAST_DROPS

    def met(decisions: DataFrame, how: str) -> DataFrame:
        asked = F.broadcast(decisions) if small else decisions
        same = keyed["__id"].eqNullSafe(asked["id"]) & (keyed["__key"] == asked["key"])
        here = F.xxhash64(keyed["__id"], keyed["__key"]) == asked["place"]
        return keyed.join(asked, here & F.coalesce(same, F.lit(False)), how)  # one long is the join's key, the rest a filter

    decisions = judged.select("place", "id", "key")
    kept = met(decisions, "left_anti").select("__row.*")
    repeated = judged.where("stays").select("place", "id", "key")
    if repeated.isEmpty():
        return kept
    once = met(repeated, "left_semi").groupBy("__id", "__key").agg(F.first("__row").alias("__row"))
    return kept.unionByName(once.select("__row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all documents, 4-word n-grams, similarity 0.85 or more."""
    return join_components(workspace.table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {N_WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {N_WORDS} + 2), lambda i: array_to_string(w[i:i + {N_WORDS - 1}], ' ')) END) AS g
  FROM w),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE {DEN} * o >= {NUM} * (a.n + b.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT rid, rid FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT r.x, min(doc_id) AS component_id FROM r JOIN w ON w.rid = r.y GROUP BY r.x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (rid) JOIN c ON c.x = w.rid
"""
