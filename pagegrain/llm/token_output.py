"""Token ids as bit-plane shuffled, zstandard-compressed chunks.

File format: a folder of Parquet files whose rows are self-contained chunks, in ascending document
order: ``segment, chunk`` (order), ``first_id`` (ids of
the segment before), ``n_docs, n_ids``, ``doc_index`` (document ids and id counts) and ``payload``.
A payload is::

    b"BPL1" | u8 planes | u8 mode (0 byte planes, 1 bit planes) | u32 ids | u32 ids of a block
    | u32 number of blocks | u32 compressed bytes of each plane of each block | the planes

Ids are cut into blocks of a fixed size; each block is transposed into byte planes (all lowest
bytes, then all next ones) or bit planes, and each plane is compressed by itself, so the
index finds any block without reading the others.

Order: documents are dealt into segments, ranges of document ids with boundaries at quantiles of the
id column; rows go straight to the task of their segment and are sorted there.  A task takes a run of neighbouring segments
(``tasks_of``), so files and shuffled blocks do not become more with every 1,024 documents.  An id (or null) that several
boundaries fall on is a hot one: its rows are dealt into as many segments, one after the other, by a hash of
their text and place in the input.  A start position is the
sum of the segments before (one number per segment), of ``first_id`` and of the documents before in the chunk.

Edge cases: a null or empty text has the end id only.  Null ids come first.  Rows with the
same id are all written, ordered by the crc of their ids inside a segment.  No documents: no chunks, no rows.  Only
segment boundaries and sums (at most ``MAX_SEGMENTS``) reach the driver.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pieces, textscan, workspace

END_ID = 2
BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 19
ROWS_PER_SEGMENT = 1024
MAX_SEGMENTS = 20_000
SEGMENTS_PER_TASK = 16
MAGIC = b"BPL1"
CHUNKS = T.StructType([T.StructField("segment", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("first_id", T.LongType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("doc_index", T.BinaryType()), T.StructField("payload", T.BinaryType())])


def to_planes(ids: np.ndarray, *, bits: bool = False, block: int = BLOCK_IDS, level: int = 3) -> bytes:
    """Payload of a run of ids."""
    ids = np.ascontiguousarray(ids, "<u4")
    planes = max(1, (int(ids.max()).bit_length() + 7) // 8) if len(ids) else 1
    press = zstandard.ZstdCompressor(level=level)
    sizes, parts = [], []
    for a in range(0, len(ids), block):
        raw = ids[a:a + block].view(np.uint8).reshape(-1, 4)[:, :planes]
        cut = np.packbits(np.unpackbits(raw, axis=1).T, axis=1) if bits else raw.T
        for plane in cut:
            parts.append(press.compress(np.ascontiguousarray(plane).tobytes()))
            sizes.append(len(parts[-1]))
    n = -(-len(ids) // block)
    return MAGIC + struct.pack("<BBIII", planes, bits, len(ids), block, n) + np.array(sizes, "<u4").tobytes() + b"".join(parts)


def from_planes(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of a payload; of blocks [first, last) if given, without reading the others."""
    if payload[:4] != MAGIC:
        raise ValueError("not a payload of token planes")
    planes, bits, total, block, n = struct.unpack_from("<BBIII", payload, 4)
    each = planes * 8 if bits else planes
    sizes = np.frombuffer(payload, "<u4", n * each, 18)
    ends = 18 + 4 * n * each + np.cumsum(sizes, dtype=np.int64)
    press, out = zstandard.ZstdDecompressor(), []
    for b in range(first, n if last is None else min(last, n)):
        rows = min(block, total - b * block)
        cut = [np.frombuffer(press.decompress(payload[ends[i] - sizes[i]:ends[i]]), np.uint8) for i in range(b * each, (b + 1) * each)]
        raw = np.packbits(np.unpackbits(np.stack(cut), axis=1)[:, :rows].T, axis=1) if bits else np.stack(cut, axis=1)
        wide = np.zeros((rows, 4), np.uint8)
        wide[:, :planes] = raw
        out.append(wide.view("<u4").ravel())
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def library_encoder(spec: str) -> pieces.Encoder:
    """Encoder that asks the tokenizers library for every piece not seen before.

    Pieces without white space inside are handed over many at a time, one on a line: the library's own
    pattern ends a piece before each line break, so their ids come back between line breaks' ids.
    """
    import json

    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    t.no_truncation(), t.no_padding()
    special = {x["content"]: x["id"] for x in json.loads(spec)["added_tokens"]}
    plain = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    (line,) = plain(["\n"])[0]

    def encode_new(new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        odd = np.fromiter((p.isspace() or "\n" in p for p in new), bool, len(new))
        one, other = np.flatnonzero(~odd), np.flatnonzero(odd)
        texts = [new[i] for i in one.tolist()]
        lines = plain(["\n".join(texts[i:i + 64]) + "\n" for i in range(0, len(texts), 64)])
        flat, _ = pieces.flattened(lines)
        breaks = np.flatnonzero(flat == line)
        if len(breaks) != len(one):
            raise ValueError("the tokenizer does not keep line breaks as ids of their own")
        rest, more = pieces.flattened(plain([new[i] for i in other.tolist()]))
        return np.concatenate([one, other]), np.concatenate([flat[flat != line], rest]), np.concatenate([np.diff(breaks, prepend=-1) - 1, more])

    return pieces.Encoder(encode_new, special)


_WORKER: dict[str, pieces.Encoder] = {}


def worker_encoder(spec: str) -> pieces.Encoder:
    """The encoder of this Python worker: later tasks of the worker find the pieces of earlier ones."""
    if spec not in _WORKER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        _WORKER.clear()
        _WORKER[spec] = library_encoder(spec)
    return _WORKER[spec]


NULL_ID = np.iinfo(np.int64).min


def segment_bounds(docs: DataFrame, doc_id: str, rows_per_segment: int) -> list[int]:
    """Ascending ids at which a new segment begins (the first begins before all); hot ids occur more than once."""
    key = F.col(f"`{doc_id}`").cast("long")
    n, known = docs.agg(F.count(F.lit(1)), F.count(key)).first()
    segments = min(MAX_SEGMENTS, n // rows_per_segment)
    if segments < 2:
        return []
    dealt = segments * known // n
    at = docs.select(F.percentile_approx(key, [i / dealt for i in range(1, dealt)], 100 * dealt)).first()[0] if dealt > 1 else []
    return [NULL_ID] * (segments - dealt) + sorted(at or [])


def segment_of(key: np.ndarray, salt: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Segment of each id: how many boundaries are at or below it; salt deals the rows of a hot id."""
    lo, hi = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
    return np.where(hi - lo > 1, lo + 1 + salt % np.maximum(hi - lo, 1), hi)


def tasks_of(segments: int, shuffle_partitions: int) -> int:
    """Tasks that write the segments: as many as Spark's shuffles have, but of at most ``SEGMENTS_PER_TASK`` segments each."""
    return min(segments, max(shuffle_partitions, -(-segments // SEGMENTS_PER_TASK)))


def _encode(docs: DataFrame, doc_id: str, text: str, spec: str, end_id: int, bounds: list[int]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast((spec, np.array(bounds, np.int64)))
    schema = "segment int, doc_id long, n long, crc long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, cuts = held.value
        encoder = worker_encoder(spec)
        for x in (piece for whole in batches for piece in textscan.slices(whole, 1)):
            ids, crcs, sizes = [], [], []
            for own in encoder.column(x.column(1)):
                own = np.append(own, np.uint32(end_id)).astype("<u4")
                crcs.append(zlib.crc32(own))
                ids.append((own.astype("<u2") if own.max() < 65536 else own).tobytes())
                sizes.append(len(own))
            key = x.column(0).fill_null(NULL_ID).to_numpy()
            segment = segment_of(key, x.column(2).to_numpy(), cuts)
            yield pa.RecordBatch.from_arrays([pa.array(segment, pa.int32()), x.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(ids, pa.binary())], names=["segment", "doc_id", "n", "crc", "ids"])

    salt = F.pmod(F.xxhash64(F.col("text"), F.monotonically_increasing_id()), F.lit(1 << 31)).alias("salt")
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).select("doc_id", "text", salt).mapInArrow(run, schema)


def _pack(chunk_ids: int, bits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, chunk, first, docs, parts, size = None, 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            index = np.array([(d if d is not None else 0, n, d is None) for d, n in docs], [("id", "<i8"), ("n", "<i8"), ("null", "u1")])
            cols = [[segment], [chunk], [first], [len(docs)], [size], [zlib.compress(index.tobytes(), 1)], [to_planes(np.concatenate(parts), bits=bits)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=CHUNKS.names)

        for x in batches:
            for s, d, n, raw in zip(*(x.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if docs and (s != segment or size >= chunk_ids):
                    yield flush()
                    chunk, first = (chunk + 1, first + size) if s == segment else (0, 0)
                    docs, parts, size = [], [], 0
                segment = s
                docs.append((d, n))
                parts.append(np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4"))
                size += n
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str, end_id: int = END_ID, bits: bool = False, rows_per_segment: int = ROWS_PER_SEGMENT, chunk_ids: int = CHUNK_IDS) -> str:
    """Encode every whole text, append ``end_id`` and write the chunks to ``path``; tokenizer: a file's content."""
    bounds = segment_bounds(docs, doc_id, rows_per_segment)
    encoded = _encode(docs, doc_id, text, tokenizer, end_id, bounds)
    segments = len(bounds) + 1
    tasks = tasks_of(segments, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    task = F.floor(F.col("segment").cast("long") * tasks / segments).cast("int")
    placed = encoded.repartitionById(tasks, task).sortWithinPartitions("segment", F.col("doc_id").asc_nulls_first(), "crc")
    placed.mapInArrow(_pack(chunk_ids, bits), CHUNKS).write.parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in a folder of chunks."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    begin, starts = 0, {}
    for r in chunks.groupBy("segment").agg(F.sum("n_ids").alias("n")).orderBy("segment").collect():
        starts[r["segment"]] = begin
        begin += r["n"]
    where = spark.sparkContext.broadcast(starts)
    fields = [("doc_id", T.LongType(), pa.int64()), ("start", T.LongType(), pa.int64()), ("n_tokens", T.LongType(), pa.int64()), ("ids_crc32", T.LongType(), pa.int64())] + ([("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))] if with_ids else [])
    names = [f[0] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for s, first, index, payload in zip(*(x.column(i).to_pylist() for i in (0, 2, 5, 6)), strict=True):
                docs = np.frombuffer(zlib.decompress(index), [("id", "<i8"), ("n", "<i8"), ("null", "u1")])
                ids = from_planes(payload)
                upto = np.cumsum(docs["n"])
                own = [ids[e - n:e] for e, n in zip(upto.tolist(), docs["n"].tolist(), strict=True)]
                cols = [pa.array(docs["id"], mask=docs["null"].astype(bool)), pa.array(where.value[s] + first + upto - docs["n"]), pa.array(docs["n"]), pa.array([zlib.crc32(np.ascontiguousarray(o)) for o in own], pa.int64())]
                if with_ids:
                    cols.append(pa.array([o.astype(np.int32) for o in own], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return chunks.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t, _ in fields]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: encode all documents, write them, read them back."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    docs = workspace.table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_tokens(spark, write_tokens(docs, workspace.new_path(spark, "tokens"), tokenizer=spec))
