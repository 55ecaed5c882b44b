"""The whole audit: from fetch results to page results, and jobs around it.

``audit_pages`` is lazy and works on any number of pages and sites; ``run_job`` crawls one site, stores
its result and cache entry, and is the only part that collects (one site has at most 100 pages).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources import fetch, report
from ..sources.jobs import Store, normalized_request, request_config
from . import aggregate, chunk, crawl, extract, model_output, prompts, signals, similarity

MATCHES, MATCH_MIN = 3, 0.72
NO_TEXT = "No meaningful visible text was extracted."
NO_PAGES = "No accessible pages with extractable HTML content were found."
NO_CHUNKS = "No meaningful extracted text was available for analysis."
OUTPUT = "chunk_id string, attempt int, text string, error string"


def is_weak(n_sections: Column, chars: Column) -> Column:
    """Extractions worth a rendered fetch."""
    return (n_sections == 0) | (chars < 300) | ((n_sections <= 1) & (chars < 600))


def quality(n_sections: Column, chars: Column) -> Column:
    return chars + n_sections * 120


def extract_visits(visits: DataFrame, rendered: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages with page_ord, failed pages, warnings) of crawl visits.

    rendered: fetch results of a browser, by URL.  They replace a failed fetch, a page without text, and a
    weak page if they are better.
    """
    raw = extract.extract_pages(visits, final_url="final_url", ok="ok", status="status", error="error")
    sized = lambda df: df.withColumn("__n", F.coalesce(F.size("sections"), F.lit(0)))
    raw = sized(raw)
    usable = (F.col("text_char_count") > 0) & (F.col("__n") > 0)
    body = ["url", "final_url", "canonical_url", "title", "h1", "text_char_count", "sections", "warnings"]
    row = F.struct(*body).alias("page")
    reason = F.when(~F.col("ok"), F.coalesce("error", "status")).when(~usable, NO_TEXT)
    stage = F.when(~F.col("ok"), "fetch").otherwise("extraction")
    base = raw.select("visit_ord", "url", F.col("ok"), (F.col("ok") & usable).alias("good"), is_weak(F.col("__n"), F.col("text_char_count")).alias("weak"), quality(F.col("__n"), F.col("text_char_count")).alias("q"), reason.alias("reason"), stage.alias("stage"), F.coalesce("final_url", "url").alias("__at"), row)
    base = base.withColumn("__ask", ~F.col("good") | F.col("weak"))
    if rendered is None:
        df = base.select("visit_ord", "url", "good", "reason", "stage", "page", F.lit(None).cast("string").alias("note"))
    else:
        got = fetch.lookup(base.where("__ask").select("visit_ord", F.col("__at").alias("url")), rendered)
        again = sized(extract.extract_pages(got, final_url="final_url", ok="ok", status="status", error="error"))
        again = again.select("visit_ord", F.col("ok").alias("r_ok"), (F.col("ok") & usable).alias("r_good"), quality(F.col("__n"), F.col("text_char_count")).alias("r_q"), F.coalesce("error", "status").alias("r_error"), row.alias("r_page"))
        df = base.join(again, "visit_ord", "left")
        better = F.coalesce(F.col("r_good") & (~F.col("good") | (F.col("r_q") > F.col("q"))), F.lit(False))
        note = (
            F.when(F.col("__ask") & ~F.coalesce("r_ok", F.lit(False)), F.concat(F.lit("Playwright fallback could not fetch "), F.col("__at"), F.lit(": "), F.coalesce("r_error", F.lit(""))))
            .when(better & F.col("good"), F.concat(F.lit("Playwright fallback improved extraction for "), F.col("url"), F.lit(".")))
            .when(better & F.col("ok"), F.concat(F.lit("Playwright fallback recovered extractable content for "), F.col("url"), F.lit(".")))
        )
        df = df.select("visit_ord", "url", (F.col("good") | better).alias("good"), "reason", "stage", F.when(better, F.col("r_page")).otherwise(F.col("page")).alias("page"), note.alias("note"))
    pages = df.where("good").select(F.col("visit_ord").alias("page_ord"), "page.*")
    return pages, df.where("not good").select("visit_ord", "url", "reason", "stage"), df.where("note is not null").select("visit_ord", F.col("note").alias("message"))


@dataclass
class Audit:
    pages: DataFrame
    chunks: DataFrame
    signals: DataFrame
    findings: DataFrame
    prompts: DataFrame
    analysis: DataFrame
    results: DataFrame
    priorities: DataFrame


def audit_pages(pages: DataFrame, *, answer: Callable[[DataFrame], DataFrame] | None = None, embed: Callable | None = None) -> Audit:
    """All stages over extracted pages (page_ord and the extraction's columns).

    answer: from (chunk_id, prompt) to model outputs (chunk_id, attempt, text, error).  Without it, chunks have no recommendations.
    Duplicate findings are capped per site.
    """
    chunks = chunk.chunk_sections(pages).join(pages.select(F.col("url").alias("page_url"), "page_ord"), "page_url")
    chunks = cut_lineage(chunks.withColumn("ord", F.col("page_ord") * 1_000_000 + F.col("chunk_order")))
    found = signals.page_signals(pages, chunks)
    vectors = cut_lineage(similarity.embed_chunks(chunks, embed or similarity.hashed_vectors))
    findings = cut_lineage(similarity.duplicate_findings(chunks, vectors, per_site=True))
    side = chunks.select(F.col("chunk_id").alias("id"), F.col("page_url").alias("page"), "ord").join(vectors.select(F.col("chunk_id").alias("id"), "vector"), "id")
    side = cut_lineage(side)
    near = similarity.similar(side, side, top_k=MATCHES, min_similarity=MATCH_MIN, cross_page_only=True)
    asked = prompts.build_prompts(chunks, found, near, findings)
    if answer is None:
        outputs = chunks.select("chunk_id", F.lit(0).alias("attempt"), F.lit("{}").alias("text"), F.lit(None).cast("string").alias("error"))
    else:
        outputs = answer(asked.select("chunk_id", "prompt"))
    analysis = cut_lineage(model_output.analyze(chunks.select("chunk_id", "page_url", "section_id", "section_path"), outputs).join(chunks.select("chunk_id", "ord"), "chunk_id"))
    rec = lambda name: analysis.select("page_url", "ord", F.posexplode(name).alias("pos", "r")).select("page_url", (F.col("ord").cast("long") * (1 << 31) + F.col("pos")).alias("rec_ord"), "r.*")
    warned = analysis.select("page_url", "ord", F.explode("warnings").alias("warning"))
    results = cut_lineage(aggregate.page_results(pages, chunks, found, similarity.findings_by_page(findings), rec("improvements"), rec("missing_content"), warned))
    return Audit(pages, chunks, found, findings, asked, analysis, results, aggregate.top_priorities(results))


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


def run_job(store: Store, job_id: str, fetcher, *, rendered: DataFrame | None = None, answer: Callable[[DataFrame], DataFrame] | None = None, embed: Callable | None = None, reports: str | None = None) -> dict | None:
    """Run a queued job: crawl, extract, analyse, store.  Any failure marks the job as failed."""
    spark: SparkSession = store.spark
    job = store.job(job_id)
    if job is None:
        return None
    store.update(job_id, "running", 0.05)
    try:
        try:
            config = json.loads(job["request_config_json"] or "{}")
        except ValueError:
            config = {}
        found = crawl.discover(spark, job["normalized_url"], fetcher, max_pages=config.get("max_pages"), max_depth=config.get("max_depth"))
        store.update(job_id, "running", 0.2)
        use = rendered if config.get("use_playwright_fallback") else None
        pages, failed, notes = extract_visits(found.visits, use)
        pages, failed = cut_lineage(pages), cut_lineage(failed)
        warnings = [r["message"] for r in found.warnings.collect()] + [r["message"] for r in notes.orderBy("visit_ord").collect()]
        if pages.isEmpty():
            store.update(job_id, "failed", error=NO_PAGES)
            return None
        store.update(job_id, "running", 0.35)
        a = audit_pages(pages, answer=answer, embed=embed)
        if a.chunks.isEmpty():
            store.update(job_id, "failed", error=NO_CHUNKS)
            return None
        store.update(job_id, "running", 0.9)
        said = [r["w"] for r in a.analysis.select("ord", F.posexplode("warnings").alias("p", "w")).orderBy("ord", "p").collect()]
        critical = not a.analysis.where(F.exists("warnings", model_output.is_critical)).isEmpty()
        lost = _rows(failed.orderBy("visit_ord").drop("visit_ord"))
        status = "partial" if lost or critical else "completed"
        shown = _rows(a.results.orderBy("page_ord"))
        summary = aggregate.summarize(a.results, failed=failed, chunks=a.chunks, findings=a.findings, signals=a.signals).first().asDict()
        result = {"job_id": job_id, "status": status, "message": aggregate.result_message(status, summary["pages_analyzed"]), "input_url": job["input_url"], "normalized_url": job["normalized_url"], "generated_at": datetime.now(UTC).isoformat(), "summary": summary, "top_priorities": _rows(a.priorities), "pages": shown, "failed_pages": lost, "warnings": warnings + said}
        if reports and (config.get("include_html_report") or config.get("enable_html_reports")):
            try:
                result["html_report_path"] = str(report.write(result, reports))
            except OSError as e:
                result["warnings"].append(f"HTML report generation failed: {e}")
        store.save_result(job_id, result)
        store.update(job_id, status, 1.0, None if status == "completed" else "Audit completed with partial results.")
        if not critical:
            store.save_cache(store.job(job_id))
        return result
    except Exception as e:
        store.update(job_id, "failed", error=f"Pipeline failed: {e}")
        return None


def submit(store: Store, url: str, *, force_refresh: bool = False, **options) -> tuple[str, bool]:
    """(job id, whether it is a cached one) of a request."""
    config = request_config(normalized_request(store.spark, url), **options)
    hit = store.cached(config, force_refresh=force_refresh)
    return (hit["job_id"], True) if hit else (store.create(url, config), False)


def answer(store: Store, job_id: str) -> tuple[int, dict]:
    """(HTTP-like code, body): 200 with the result, 202 while it runs, 500 if it failed, 404 if unknown."""
    job = store.job(job_id)
    if job is None:
        return 404, {"error": "job_not_found"}
    result = store.result(job_id)
    if result is not None:
        return 200, result
    return (500, {"error": job["error_message"] or "failed"}) if job["status"] == "failed" else (202, {"job_id": job_id, "status": job["status"]})
