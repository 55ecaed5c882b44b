"""Streaming variants: pages that arrive in a folder, and the job log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx
from ..functions import urls

PAGES = "page_id long, url string, html string"


def read_pages(spark: SparkSession, path: str, *, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of pages as a stream."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def page_facts(pages: DataFrame) -> DataFrame:
    """Row-wise facts of a page: canonical URL, host, depth, size.  The same for streams and tables."""
    url = urls.canonical_url(F.col("url"))["url"]
    return pages.withColumn("normalized_url", url).select("page_id", "normalized_url", urls.host_key(F.col("normalized_url")).alias("host"), urls.path_depth(F.col("normalized_url")).alias("depth"), F.length(tx.normalize_whitespace(F.coalesce("html", F.lit("")))).alias("html_chars"))


def status_counts(events: DataFrame, *, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events (at, status) counted in tumbling windows; later ones than the watermark are dropped."""
    return events.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "status").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "status", "n")


def write_facts(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the facts to a Parquet folder, once for all that is there."""
    return page_facts(pages).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
