"""Findings and recommendations to page results, priorities and a summary."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.pagetype import page_type

# Fixed values.
MAX_IMPROVEMENTS, MAX_MISSING, MAX_DUPLICATES, MAX_PRIORITIES = 12, 8, 6, 8
RANK = {"high": 4, "medium": 3, "low": 2, "info": 1}
POINTS = {"high": 64.0, "medium": 44.0, "low": 24.0, "info": 10.0}
PAGE_BONUS = {"homepage": 8.0, "pricing": 7.0, "services_product": 6.5, "contact": 4.0, "about": 3.0, "faq": 2.5, "docs": 2.5}
CATEGORY_BONUS = {"cta": 7.0, "trust": 6.0, "missing_context": 4.5, "clarity": 3.0, "structure": 3.0, "readability": 2.5, "duplication": 2.0, "engagement": 2.0}
SUPPORT = {
    "cta": ("missing_cta", "generic_cta"), "trust": ("missing_trust_indicators", "vague_marketing_language"), "missing_context": ("thin_page", "thin_section", "weak_structure"),
    "clarity": ("weak_heading", "vague_marketing_language"), "structure": ("weak_structure", "dense_section", "oversized_chunk"), "readability": ("long_paragraph", "dense_section", "oversized_chunk"), "duplication": ("repeated_heading", "repeated_phrase"),
}
SUMMARY = ("pages_analyzed", "pages_failed", "chunks_analyzed", "improvements_count", "missing_content_count", "duplicate_findings_count", "heuristic_signals_count")
MESSAGES = {"completed": "Audit completed successfully.", "partial": "Audit completed with partial results and warnings."}


def exact_decimal(x: float, digits: int) -> Decimal:
    """``x`` at so many digits, from its exact binary value, halves to even."""
    return Decimal(x).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_EVEN)


def _exact(digits: int):
    @F.pandas_udf(T.StringType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else str(exact_decimal(v, digits)))

    return run


round_1, show_2 = _exact(1), _exact(2)


def _pick(table: dict, key: Column, other) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), key), F.lit(other))


def severity_rank(level: Column) -> Column:
    return _pick(RANK, level, 0)


def dedupe_key(*values: Column) -> Column:
    return F.concat_ws("|", *[F.lower(tx.normalize_whitespace(v)) for v in values])


def best_per_key(df: DataFrame, key: Column, level: str) -> DataFrame:
    """One recommendation per page and key: the most confident, of equals the first; ``place`` ranks them per page.

    rec_ord orders the rows.  Ties of level and confidence keep the order in which keys first came.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    one = df.withColumn("__key", key).groupBy("page_url", "__key").agg(F.max(F.struct(F.col("confidence"), (-F.col("rec_ord")).alias("o"), own.alias("row"))).alias("m"), F.min("rec_ord").alias("__first"))
    order = W.partitionBy("page_url").orderBy(severity_rank(F.col(level)).desc(), F.desc("confidence"), "__first")
    return one.select("m.row.*", "__first").withColumn("place", F.row_number().over(order)).drop("__first")


def dedupe_improvements(df: DataFrame) -> DataFrame:
    return best_per_key(df, dedupe_key(F.col("category"), F.col("issue"), F.col("suggested_change")), "severity")


def dedupe_missing(df: DataFrame) -> DataFrame:
    return best_per_key(df, dedupe_key(F.col("missing_content"), F.col("suggestion_or_outline")), "priority")


def missing_category(*texts: Column) -> Column:
    """Category by which missing content is scored."""
    t = F.lower(F.concat_ws(" ", *texts))
    return F.when(tx.contains_any(t, ("cta", "call to action", "next step")), "cta").when(tx.contains_any(t, ("trust", "proof", "testimonial", "review", "case study", "customer", "credibility")), "trust").otherwise("missing_context")


def recommendation_priority(df: DataFrame, *, level: str, category: str = "category") -> DataFrame:
    """``df`` (page_type, signal_types, confidence, level, category) with priority_score and why_prioritized."""
    kind, cat = F.col("page_type"), F.col(category)
    page, extra = _pick(PAGE_BONUS, kind, 0.0), _pick(CATEGORY_BONUS, cat, 1.0)
    wanted = F.coalesce(F.element_at(F.create_map(*[x for k, v in SUPPORT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), cat), F.array().cast("array<string>"))
    n = F.size(F.array_intersect(F.coalesce("signal_types", F.array().cast("array<string>")), wanted))
    raw = F.least(F.lit(100.0), _pick(POINTS, F.col(level), 10.0) + F.col("confidence") * 12.0 + page + extra + F.least(n * 4.0, F.lit(8.0)))
    parts = F.array_compact(F.array(
        F.concat(F.col(level), F.lit(" severity")), F.concat("__conf", F.lit(" confidence")), F.when(page > 0, F.concat(F.replace(kind, F.lit("_"), F.lit("/")), F.lit(" page"))),
        F.when(extra >= 4.0, F.concat(F.replace(cat, F.lit("_"), F.lit(" ")), F.lit(" issue"))), F.when(n == 1, "supported by heuristic signal").when(n > 1, "supported by heuristic signals"),
    ))
    df = df.withColumns({"priority_score": round_1(raw).cast("double"), "__conf": show_2(F.col("confidence"))})
    return df.withColumn("why_prioritized", F.concat(F.array_join(parts, "; "), F.lit("."))).drop("__conf")


def duplicate_priority(df: DataFrame) -> DataFrame:
    page = _pick(PAGE_BONUS, F.col("page_type"), 0.0)
    df = df.withColumns({"priority_score": round_1(F.least(F.lit(100.0), 42.0 + F.col("similarity_score") * 26.0 + page)).cast("double"), "__sim": show_2(F.col("similarity_score"))})
    parts = F.array_compact(F.array(F.lit("cross-page overlap"), F.concat("__sim", F.lit(" similarity")), F.when(page > 0, F.concat(F.replace("page_type", F.lit("_"), F.lit("/")), F.lit(" page")))))
    return df.withColumn("why_prioritized", F.concat(F.array_join(parts, "; "), F.lit("."))).drop("__sim")


def page_kinds(pages: DataFrame, signals: DataFrame) -> DataFrame:
    """(page_url, page_ord, page_type, signal_types, top signal) of each page; the top signal is the most frequent, of equals the first."""
    counts = signals.groupBy("page_url", "signal_type").agg(F.count(F.lit(1)).alias("n"), F.min("signal_ord").alias("first"))
    by = counts.groupBy("page_url").agg(F.collect_set("signal_type").alias("signal_types"), F.max(F.struct("n", (-F.col("first")).alias("f"), "signal_type")).alias("top"), F.sort_array(F.collect_list(F.struct("first", "signal_type", "n"))).alias("by_type"))
    kind = page_type(F.col("url"), F.coalesce("title", F.lit("")), F.coalesce("h1", F.lit("")))
    return pages.select(F.col("url").alias("page_url"), "page_ord", "title", kind.alias("page_type"), F.size("sections").alias("sections_analyzed"), F.transform("warnings", lambda w: w["message"]).alias("extraction_warnings")).join(by, "page_url", "left")


def page_results(pages: DataFrame, chunks: DataFrame, signals: DataFrame, findings_by_page: DataFrame, improvements: DataFrame, missing: DataFrame, chunk_warnings: DataFrame) -> DataFrame:
    """One row per page: type, summary text, counts, capped recommendations and warnings.

    improvements and missing carry page_url, rec_ord and their fields; chunk_warnings page_url, ord, warning.
    """
    kinds = page_kinds(pages, signals)
    n_chunks = chunks.groupBy("page_url").agg(F.count(F.lit(1)).cast("int").alias("chunks_analyzed"))

    def ranked(df: DataFrame, cap: int, name: str) -> DataFrame:
        fields = [c for c in df.columns if c not in ("page_url", "rec_ord", "place")]
        top = F.sort_array(F.collect_list(F.when(F.col("place") <= cap, F.struct("place", F.struct(*fields).alias("x")))))
        return df.groupBy("page_url").agg(F.transform(top, lambda r: r["x"]).alias(name), F.count(F.lit(1)).alias(f"n_{name}"))

    order = W.partitionBy("page_url").orderBy(F.desc("similarity_score"), "left_ord", "right_ord", "side")
    dup = findings_by_page.withColumn("place", F.row_number().over(order)).drop("left_ord", "right_ord", "side")
    warned = chunk_warnings.groupBy("page_url").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "warning"))), lambda w: w["warning"]).alias("warnings"))
    df = kinds.join(n_chunks, "page_url", "left")
    for part in (ranked(dedupe_improvements(improvements), MAX_IMPROVEMENTS, "improvements"), ranked(dedupe_missing(missing), MAX_MISSING, "missing_content"), ranked(dup, MAX_DUPLICATES, "duplicate_warnings"), warned):
        df = df.join(part, "page_url", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    text = F.concat(zero("sections_analyzed"), F.lit(" sections; "), zero("n_improvements"), F.lit(" improvements; "), zero("n_missing_content"), F.lit(" missing-content suggestions"), F.when(F.col("top").isNotNull(), F.concat(F.lit("; top heuristic: "), F.col("top.signal_type"), F.lit(" ("), F.col("top.n"), F.lit(")"))).otherwise(""), F.lit("."))
    lists = {c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)) for c in ("improvements", "missing_content", "duplicate_warnings", "warnings", "signal_types")}
    return df.withColumns({**lists, "summary": text, "chunks_analyzed": zero("chunks_analyzed")}).drop("n_improvements", "n_missing_content", "n_duplicate_warnings", "top")


def result_message(status: str, pages_analyzed: int) -> str:
    """What a result says about its job."""
    return MESSAGES.get(status) or ("Audit produced usable results with warnings." if pages_analyzed else "Audit did not produce usable results.")


def top_priorities(results: DataFrame, limit: int = MAX_PRIORITIES) -> DataFrame:
    """The most urgent entries of all pages: a top-k over what pages show."""
    keep = ["page_url", "page_ord", "page_type", "signal_types"]
    imp = results.select(*keep, F.posexplode("improvements").alias("pos", "r")).select(*keep, "pos", F.lit(0).alias("kind"), F.lit("improvement").alias("type"), F.col("r.category").alias("category"), F.col("r.severity").alias("severity"), F.col("r.confidence").alias("confidence"), F.col("r.issue").alias("issue"), F.col("r.suggested_change").alias("suggestion"))
    mis = results.select(*keep, F.posexplode("missing_content").alias("pos", "r")).select(*keep, "pos", F.lit(1).alias("kind"), F.lit("missing_content").alias("type"), missing_category(F.col("r.missing_content"), F.col("r.suggestion_or_outline"), F.col("r.reason")).alias("category"), F.col("r.priority").alias("severity"), F.col("r.confidence").alias("confidence"), F.col("r.missing_content").alias("issue"), F.col("r.suggestion_or_outline").alias("suggestion"))
    rec = recommendation_priority(imp.unionByName(mis).where(F.col("severity").isin("high", "medium")), level="severity")
    dup = results.select(*keep, F.posexplode("duplicate_warnings").alias("pos", "r")).select(*keep, "pos", F.lit(2).alias("kind"), F.lit("duplicate_content").alias("type"), F.lit(None).cast("string").alias("category"), F.lit("medium").alias("severity"), F.col("r.similarity_score").alias("confidence"), F.col("r.similarity_score").alias("similarity_score"), F.col("r.message").alias("issue"), F.lit(None).cast("string").alias("suggestion"))
    both = rec.unionByName(duplicate_priority(dup).drop("similarity_score"))
    top = both.orderBy(F.desc("priority_score"), severity_rank(F.col("severity")).desc(), F.desc("confidence"), "page_ord", "kind", "pos").limit(limit)
    return top.select("type", "page_url", "category", "severity", "confidence", "priority_score", "why_prioritized", "issue", "suggestion")


def summarize(results: DataFrame, *, failed: DataFrame, chunks: DataFrame, findings: DataFrame, signals: DataFrame) -> DataFrame:
    """One row of counters: recommendations as shown (after caps), findings and signals before."""
    counters = [results.select(F.lit("pages_analyzed").alias("k"), F.lit(1).alias("v")), results.select(F.lit("improvements_count").alias("k"), F.size("improvements").alias("v")), results.select(F.lit("missing_content_count").alias("k"), F.size("missing_content").alias("v"))]
    counters += [df.select(F.lit(k).alias("k"), F.lit(1).alias("v")) for df, k in ((failed, "pages_failed"), (chunks, "chunks_analyzed"), (findings, "duplicate_findings_count"), (signals, "heuristic_signals_count"))]
    rows = counters[0]
    for c in counters[1:]:
        rows = rows.unionByName(c)
    return rows.agg(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("v"))), F.lit(0)).alias(k) for k in SUMMARY])
