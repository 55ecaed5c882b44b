"""Sharding by sampled splitters.

Records are ordered by (digest of the text, id, place in the input): equal texts stand together, and any group of
equal texts, however large, can be cut between its rows.  Rows that are equal in text and id are alike in the result,
so it does not depend on where they stood.

1. A slim table (id, size, crc, key, place) is written once; texts are read a single time.
2. Rows enter the sample with a probability in proportion to their size; quantiles of the sampled
   keys are the boundaries of many ranges.
3. The exact bytes of all ranges are summed.  Ranges over ``overfull`` times their share are
   sampled again and subdivided, until none is left or (as with one record larger than a share) nothing more can be cut.
4. Inside its range each row gets its exact running bytes and rank.  Offsets of the ranges (one row
   per range) turn these into global ones, and the ``bytes`` law follows: a row goes to the shard
   in whose equal share of all bytes its middle lies.  Shard sizes differ by about one row's size.

Driver and broadcast hold boundaries and sums of ranges only: ``ranges_per_shard`` per shard, or one
for each ``range_bytes`` up to ``max_ranges``.

Edge cases: a null text has no bytes (size 1, crc 0) like an empty one; a null id keeps its row and stands before others;
repeated rows stay rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import workspace

SHARDS = 8
RANGES_PER_SHARD = 64
RANGE_BYTES = 256 << 20
MAX_RANGES = 65_536
SAMPLES_PER_RANGE = 24
OVERFULL = 2.0
ROUNDS = 4


ORDER = ("key", "nameless", "id", "place")


def slim(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", place: Column | None = None) -> DataFrame:
    """Size, crc and sort key of each record, written once so that places stay as they are.

    key: the first 60 bits of the text's MD5; id: the document id as a number (nameless is 0 if it is null).
    """
    raw = F.encode(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "UTF-8")
    own, place = F.col(f"`{doc_id}`"), F.monotonically_increasing_id() if place is None else place
    key = F.conv(F.substring(F.md5(raw), 1, 15), 16, 10).cast("long")
    df = docs.select(own.alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"), key.alias("key"), own.isNotNull().cast("long").alias("nameless"), F.coalesce(own.cast("long"), F.lit(0)).alias("id"), place.alias("place"))
    return workspace.written(df, "shard-slim")


def _sample(df: DataFrame, per_byte: float, seed: int) -> list[tuple[int, ...]]:
    """Keys drawn with a probability of size * per_byte (at most 1), by a hash: repeatable."""
    chance = F.least(F.col("size") * F.lit(per_byte), F.lit(1.0))
    drawn = df.where(F.pmod(F.xxhash64(*ORDER, F.lit(seed)), F.lit(1 << 30)) < chance * (1 << 30))
    return sorted(tuple(r) for r in drawn.select(*ORDER).collect())


def with_ranges(df: DataFrame, bounds: list[tuple[int, ...]]) -> DataFrame:
    """``df`` with ``range``: how many boundaries are at or below the row's place in the order."""
    kind = np.dtype([(c, "<i8") for c in ORDER])
    cuts = np.array(bounds, kind)
    heads = np.array([b[0] for b in bounds], np.int64)
    schema = T.StructType([*df.schema.fields, T.StructField("range", T.IntegerType())])
    at = [df.columns.index(c) for c in ORDER]

    def run(batches):
        for x in batches:
            key = x.column(at[0]).to_numpy()
            lo, hi = np.searchsorted(heads, key, "left"), np.searchsorted(heads, key, "right")
            out, more = hi.copy(), np.flatnonzero(hi > lo)
            if len(more):  # a boundary has the same key: the whole order decides
                own = np.empty(len(more), kind)
                for c, i in zip(ORDER, at, strict=True):
                    own[c] = x.column(i).to_numpy()[more]
                out[more] = np.searchsorted(cuts, own, "right")
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(out, pa.int32())], names=schema.names)

    return df.mapInArrow(run, schema)


def _sums(df: DataFrame) -> dict[int, tuple[int, int]]:
    return {r["range"]: (r["bytes"], r["rows"]) for r in df.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()}


def splitters(df: DataFrame, shards: int = SHARDS, *, ranges: int | None = None, seed: int = 7) -> tuple[list[tuple[int, ...]], dict[int, tuple[int, int]]]:
    """Boundaries in the order, and (bytes, rows) of each range between them."""
    total = df.agg(F.sum("size").alias("n")).first()["n"] or 0
    if not total:
        return [], {}
    ranges = ranges or min(MAX_RANGES, max(shards * RANGES_PER_SHARD, total // RANGE_BYTES))
    share = total / ranges
    drawn = _sample(df, SAMPLES_PER_RANGE / share, seed)
    bounds = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges) if drawn})
    before = -1
    for k in itertools.count(1):
        placed = with_ranges(df, bounds)
        sums = _sums(placed)
        full = [r for r, (b, n) in sums.items() if b > OVERFULL * share and n > 1]
        if not full or (k > ROUNDS and len(bounds) == before):
            return bounds, sums
        before = len(bounds)
        more = with_ranges(df, bounds).where(F.col("range").isin(full)) if len(full) <= 1000 else placed
        drawn = _sample(more, SAMPLES_PER_RANGE / share, seed + k)
        every = SAMPLES_PER_RANGE // 2
        bounds = sorted({*bounds, *drawn[every::every]})


def placed(df: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A slim table with ``shard`` and ``slot``."""
    spark = df.sparkSession
    bounds, sums = splitters(df, shards)
    offsets, at_bytes, at_rows = [], 0, 0
    for r in sorted(sums):
        offsets.append((r, at_bytes, at_rows))
        at_bytes, at_rows = at_bytes + sums[r][0], at_rows + sums[r][1]
    table = spark.createDataFrame(offsets, "range int, at_bytes long, at_rows long")
    order = W.partitionBy("range").orderBy(*ORDER)
    inner = with_ranges(df, bounds).withColumns({"rank": F.row_number().over(order), "upto": F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))})
    shard = F.least(F.lit(shards - 1), F.expr("0") if not at_bytes else F.expr(f"cast((2 * (at_bytes + upto) - size) * {shards} div {2 * at_bytes} as int)"))
    out = inner.join(F.broadcast(table), "range").select(*df.columns, shard.cast("int").alias("shard"), (F.col("at_rows") + F.col("rank") - 1).alias("at"))
    out = workspace.written(out, "shard-placed")
    firsts = out.groupBy("shard").agg(F.min("at").alias("first_at"))
    return out.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("at") - F.col("first_at"))


def assign(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every record."""
    return placed(slim(docs, doc_id, text), shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> None:
    """The records themselves as a Parquet folder per shard, ordered by slot inside each file.

    The records are written once with their place in the input, by which they are found again: ids may repeat or be null.
    """
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("record"))
    kept = workspace.written(kept, "shard-records")
    to = placed(slim(kept.select("row.*", F.col("record").alias("__record")), doc_id, text, F.col("__record")), shards)
    joined = kept.join(to.select(F.col("place").alias("record"), F.struct("shard", "slot").alias("to")), "record")
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    out = joined.select(*[F.col(f"row.`{c}`") for c in names], "to.shard", "to.slot")
    out.repartition("shard", (F.col("slot") / 100_000).cast("int")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all documents in shards 0 to 7 by the ``bytes`` law."""
    return assign(workspace.table(spark, sf_dir, "documents").select("doc_id", "text"))
