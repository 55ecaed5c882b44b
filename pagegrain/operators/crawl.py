"""Site discovery: breadth-first by depth, by priority inside a depth, over any fetch source.

Children are always one level deeper than their page, so a level is one DataFrame pass: look up pages, explode and
filter links, keep each new URL's first link, rank, cut to the budget.  The loop runs at most
``max_depth + 1`` times, and each level's rows (never more than ``max_pages`` visits) are checkpointed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls
from ..session import cut_lineage
from ..sources import fetch
from . import links as ln

DEFAULT_PAGES, DEFAULT_DEPTH = 8, 2


@dataclass
class Crawl:
    """visits: visit_ord, url, source_url, depth, priority_score, priority_reason and the fetch result; warnings: code, message, url, source_url."""

    start_url: str
    normalized_start_url: str | None
    visits: DataFrame
    warnings: DataFrame


_VISIT = "visit_ord long, url string, source_url string, depth int, priority_score int, priority_reason string"
_WARNING = "code string, message string, url string, source_url string"


def discover(spark: SparkSession, start_url: str, fetcher: Callable[[DataFrame], DataFrame] | DataFrame, *, max_pages: int | None = None, max_depth: int | None = None) -> Crawl:
    """Visit a site from its start page and root.

    fetcher: fetch results by canonical URL, or a function from a frame with ``url`` to one with the result's columns as well.
    A max_pages or max_depth of 0 means the default, as callers of the service rely on.
    """
    max_pages, max_depth = max_pages or DEFAULT_PAGES, max_depth or DEFAULT_DEPTH
    get = fetcher if callable(fetcher) else lambda wanted: fetch.lookup(wanted, fetcher)
    result = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fetch.RESULT if f.name != "url")
    start, error = urls.canonical_one(spark, start_url)
    if error:
        return Crawl(start_url, None, spark.createDataFrame([], f"{_VISIT}, {result}"), spark.createDataFrame([("invalid_start_url", error, start_url, None)], _WARNING))
    root = start.split("/", 3)
    root = "/".join(root[:3]) + "/"
    first = [(start, 1001, "submitted_start_url")] if start != root else []
    first.append((root, 1000, "homepage"))
    level = spark.createDataFrame([(i, u, None, 0, p, r) for i, (u, p, r) in enumerate(first)], _VISIT.replace("visit_ord", "ins_ord"))
    seen = level.select("url")
    visits, done = None, 0
    for depth in range(max_depth + 1):
        order = W.orderBy(F.desc("priority_score"), "ins_ord")  # one level of one site
        chosen = level.orderBy(F.desc("priority_score"), "ins_ord").limit(max_pages - done).withColumn("visit_ord", (F.row_number().over(order) - 1 + done).cast("long")).drop("ins_ord")
        pages = cut_lineage(get(chosen.select("visit_ord", "url", "source_url", "depth", "priority_score", "priority_reason")))
        visits = pages if visits is None else visits.unionByName(pages)
        done += pages.count()
        if depth == max_depth or done >= max_pages:
            break
        found = ln.extract_links(pages.where("ok").select("visit_ord", F.col("url").alias("parent"), F.coalesce("final_url", "url").alias("base_url"), "html"))
        kept = ln.filter_links(found.withColumn("site_root", F.lit(root)), seen=seen).where("allowed")
        new = kept.groupBy(F.col("normalized_url").alias("url")).agg(F.min(F.struct("visit_ord", "pos", "parent")).alias("x"))
        score, reason = ln.priority(F.col("url"), F.lit(root))
        level = new.select((F.col("x.visit_ord").cast("long") * 1_000_000_000 + F.col("x.pos")).alias("ins_ord"), "url", F.col("x.parent").alias("source_url"), F.lit(depth + 1).alias("depth"), score.alias("priority_score"), reason.alias("priority_reason"))
        level = cut_lineage(level)
        seen = seen.unionByName(level.select("url"))
        if level.isEmpty():
            break
    failed = visits.where("not ok").orderBy("visit_ord").select(F.col("status").alias("code"), F.coalesce("error", F.lit("Fetch failed.")).alias("message"), "url", "source_url")
    return Crawl(start_url, start, visits, failed)
