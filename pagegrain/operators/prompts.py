"""Prompts for chunks: instructions, page focus and a JSON context, as one string column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.pagetype import page_type
from .model_output import CATEGORIES

MAX_TEXT, MAX_SNIPPET, MAX_SIGNALS, MAX_MATCHES, MAX_FINDINGS = 5000, 420, 6, 3, 3
MAX_INVALID, MAX_ERROR = 6000, 1200
FOCUS = {
    "homepage": "the value proposition, trust on the first screen, who the page is for, and a clear next action",
    "pricing": "what each plan includes, common objections, reassurance, comparison, and the step after choosing",
    "services_product": "benefits, proof, what sets the offer apart, the process, objections, and the outcome",
    "docs": "completeness, examples, the order of steps, terms, navigation, and whether a reader can finish the task",
    "faq": "which questions are covered, direct answers, reassurance, and objections that are missing",
    "contact": "channels, when to expect an answer, location or support, and reassurance before writing",
    "about": "credibility, mission, the people and their story, signs of trust, and reasons to believe",
    "blog": "the headline, structure, evidence, freshness, engagement, and what to read or do next",
    "generic": "clarity, usefulness, structure, trust and what readers can act on in this very text",
}
SHAPE = '{"chunk_id": "", "page_url": "", "section_id": "", "section_path": [], "improvements": [{"category": "", "issue": "", "suggested_change": "", "example_text": null, "reason": "", "severity": "info|low|medium|high", "confidence": 0.0, "evidence_snippet": null}], "missing_content": [{"recommended_location": null, "missing_content": "", "suggestion_or_outline": "", "reason": "", "priority": "info|low|medium|high", "confidence": 0.0}], "warnings": []}'
RULES = (
    "Audit the content of one chunk of a web page. Judge only the text given; signals and similar chunks are hints, not proof.\n"
    "Answer with JSON only, without Markdown or comments, in this shape:\n" + SHAPE + "\n"
    "Name concrete improvements of existing text and content that is missing. Be specific, quote evidence, invent no facts, "
    "and return empty lists where nothing is wrong. Use exactly one category of: " + ", ".join(CATEGORIES) + ". Confidence is a number from 0 to 1.\n"
)


def _top(df: DataFrame, key: str, order: list, n: int, fields: list[Column], name: str) -> DataFrame:
    """The first n rows of each key as an array; rows beyond are cut before they are gathered."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    df = df.withColumn("__rank", rank).where(F.col("__rank") <= n)
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__rank", F.struct(*fields).alias("x")))).alias("__rows")).select(key, F.transform("__rows", lambda r: r["x"]).alias(name))


def relevant_signals(chunks: DataFrame, signals: DataFrame) -> DataFrame:
    """(chunk_id, signals): of the chunk's page, and of the same section and chunk where a signal names these."""
    c = chunks.select("chunk_id", "page_url", F.col("section_id").alias("__section"))
    s = signals.withColumnRenamed("chunk_id", "__chunk")
    df = c.join(s, "page_url").where((F.col("__chunk").isNull() | (F.col("__chunk") == F.col("chunk_id"))) & (F.col("section_id").isNull() | (F.col("section_id") == F.col("__section"))))
    fields = [F.col(n) for n in ("signal_type", "severity", "confidence", "message", "evidence_snippet", "metadata")]
    return _top(df, "chunk_id", [F.col("signal_ord")], MAX_SIGNALS, fields, "signals")


def build_prompts(chunks: DataFrame, signals: DataFrame, matches: DataFrame, findings: DataFrame) -> DataFrame:
    """(chunk_id, page_type, context, prompt); matches as of ``similar`` over chunk ids, findings as of ``duplicate_findings``."""
    other = chunks.select(F.col("chunk_id").alias("match_id"), F.col("page_url").alias("matched_page_url"), F.col("section_id").alias("matched_section_id"), tx.snippet(F.col("chunk_text"), MAX_SNIPPET).alias("matched_text_snippet"))
    near = matches.join(other, "match_id").withColumnRenamed("query_id", "chunk_id")
    near = _top(near, "chunk_id", [F.col("rank")], MAX_MATCHES, [F.col("match_id").alias("matched_chunk_id"), F.col("matched_page_url"), F.col("matched_section_id"), F.col("score").alias("similarity_score"), F.col("cross_page"), F.col("matched_text_snippet")], "similar_chunks")
    names = [F.col(n) for n in ("finding_type", "source_chunk_id", "matched_chunk_id", "matched_page_url", "similarity_score", "message", "evidence_snippet", "matched_evidence_snippet", "left_ord", "right_ord")]
    both = findings.select(F.col("source_chunk_id").alias("chunk_id"), *names).unionByName(findings.where("matched_chunk_id <> source_chunk_id").select(F.col("matched_chunk_id").alias("chunk_id"), *names))
    both = _top(both, "chunk_id", [F.desc("similarity_score"), F.col("left_ord"), F.col("right_ord")], MAX_FINDINGS, names[:-2], "duplicate_context")
    kind = page_type(F.col("page_url"), F.coalesce("page_title", F.lit("")), F.coalesce("page_h1", F.lit("")))
    df = chunks.join(relevant_signals(chunks, signals), "chunk_id", "left").join(near, "chunk_id", "left").join(both, "chunk_id", "left").withColumn("page_type", kind)
    context = F.to_json(F.struct(
        F.struct(F.col("page_url").alias("url"), F.col("page_title").alias("title"), F.col("page_h1").alias("h1"), "page_type").alias("page"),
        F.struct(F.col("section_id").alias("id"), F.col("section_path").alias("path"), F.col("section_heading").alias("heading"), F.col("section_heading_level").alias("heading_level")).alias("section"),
        F.struct(F.col("chunk_id").alias("id"), F.col("chunk_order").alias("order"), "token_estimate", tx.snippet(F.col("chunk_text"), MAX_TEXT).alias("text")).alias("chunk"),
        F.coalesce("signals", F.from_json(F.lit("[]"), "array<struct<signal_type:string,severity:string,confidence:double,message:string,evidence_snippet:string,metadata:string>>")).alias("heuristic_signals"),
        "similar_chunks", "duplicate_context",
    ), {"ignoreNullFields": "false"})
    focus = F.create_map(*[F.lit(x) for p in FOCUS.items() for x in p])
    prompt = F.concat(F.lit(RULES + "On this kind of page look at "), F.element_at(focus, F.col("page_type")), F.lit(".\nContext:\n"), F.col("context"))
    return df.select("chunk_id", "page_type", context.alias("context")).withColumn("prompt", prompt)


def repair_prompt(invalid: Column, error: Column) -> Column:
    """A prompt that asks for the same answer as valid JSON."""
    context = F.to_json(F.struct(tx.snippet(F.coalesce(invalid, F.lit("")), MAX_INVALID).alias("invalid_output"), tx.snippet(F.coalesce(error, F.lit("")), MAX_ERROR).alias("validation_error")))
    return F.concat(F.lit("Turn this model output into valid JSON only, keep its recommendations, and match this shape:\n" + SHAPE + "\n"), context)
