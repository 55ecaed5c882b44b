"""Row-wise operators as Arrow batches: new columns beside all that the input had."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan, workspace

#: Name under which the text travels while a batch is worked on; never in a result.
TEXT = "__pagegrain_text"


def extend(df: DataFrame, text: str, fields: Sequence[T.StructField], work: Callable[[pa.Array], Sequence[pa.Array]], owner: str | None = None) -> DataFrame:
    """``df`` with new columns made from its text column.

    work: turns the text column of a batch into one array for each of ``fields``.  An input
    column that has the name of a new one (in any case) is replaced by it.  The text column
    may have any type; it is read as a string.  owner: as for workspace.in_arrow.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in new]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(TEXT))
    if text in kept:  # one copy travels
        source = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in kept])
        column = text
    else:
        column = TEXT
    schema = T.StructType([f for f in source.schema.fields if f.name != TEXT] + list(fields))
    names = [f.name for f in schema.fields]
    at = source.columns.index(column)
    drop = at if column == TEXT else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textscan.slices(whole, at):
                made = list(work(batch.column(at)))
                old = [batch.column(i) for i in range(batch.num_columns) if i != drop]
                yield pa.RecordBatch.from_arrays([*old, *made], names=names)

    return workspace.in_arrow(source, run, schema, owner)
