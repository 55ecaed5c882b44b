"""Where intermediate tables go: the shared folder that the cluster names.  And Arrow tasks that leave little memory behind."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch on its way to Python, where the session does not set them; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What a Python worker keeps from task to task, by owner.
_KEPT: dict[str, dict] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset on a local master (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark, "_pagegrain_dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="pagegrain-")
            spark._pagegrain_dir = base
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/pagegrain/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(owner: str) -> dict:
    """A table of this Python worker for tasks of ``owner``; the first Arrow task of another one empties it."""
    return _KEPT.setdefault(owner, {})


def begin(owner: str | None) -> None:
    for name, held in _KEPT.items():
        if name != owner:
            held.clear()


def give_back() -> None:
    """Free memory goes back to the system: a worker outlives its task, and the executor's heap grows beside it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, owner: str | None = None) -> DataFrame:
    """mapInArrow in batches of ``BATCH_BYTES``; the worker gives its free memory back after each task.

    Sets BATCH_CONF for the session, unless it is set.  owner: whose kept tables the task goes on with.
    """
    conf = df.sparkSession.conf
    conf.set(BATCH_CONF, conf.get(BATCH_CONF, str(BATCH_BYTES)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Project onto known names and types, whatever else the table holds."""
    return df.select(*[F.col(f"`{source}`").cast(kind).alias(name) for name, (source, kind) in
                       ((n, v if isinstance(v, tuple) else (n, v)) for n, v in columns.items())])


def long_fields(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]
