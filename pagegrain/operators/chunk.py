"""Sections to bounded chunks: greedy packing of sentences, as one fold per section.

A section of at most ``max_chars`` is one chunk.  A longer one is cut at sentence ends and packed up to
``target_chars``; a sentence over ``max_chars`` is packed word by word, apart from its neighbours.
The fold is SQL's ``aggregate`` over units, where an empty unit ends the current chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.barrier import computed

MAX_CHARS, TARGET_CHARS, SHORT_SECTION = 2400, 1600, 80


def _units(blocks: Column, max_chars: int) -> Column:
    end = F.array(F.lit(""))
    return F.flatten(F.transform(blocks, lambda b: F.when(F.length(b) > max_chars, F.concat(end, F.split(b, " ", -1), end)).otherwise(F.array(b))))


def pack(blocks: Column, *, max_chars: int = MAX_CHARS, target_chars: int = TARGET_CHARS) -> Column:
    """Chunks of a list of non-empty normalised blocks."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(s: Column, u: Column) -> Column:
        done, cur = s["done"], s["cur"]
        close = (cur != "") & ((u == "") | (F.length(cur) + 1 + F.length(u) > target_chars))
        return F.struct(
            F.when(close, F.concat(done, F.array(cur))).otherwise(done).alias("done"),
            F.when((u == "") | (cur == "") | close, u).otherwise(F.concat(cur, F.lit(" "), u)).alias("cur"),
        )

    return F.aggregate(_units(blocks, max_chars), state, step, lambda s: F.when(s["cur"] != "", F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]))


def chunk_sections(pages: DataFrame, *, max_chars: int = MAX_CHARS, target_chars: int = TARGET_CHARS) -> DataFrame:
    """Chunks of pages (url, title, h1, sections), with a page-wide chunk_order.

    The order is a running number inside each page: one shuffle by page, none larger.
    """
    sections = pages.select(F.col("url").alias("page_url"), F.col("title").alias("page_title"), F.col("h1").alias("page_h1"), F.inline("sections"))
    df = computed(sections, __text=tx.normalize_whitespace(F.col("text"))).where(F.col("__text") != "")
    long = F.length("__text") > max_chars
    parts = F.when(long, pack(tx.plain_sentences(F.col("__text")), max_chars=max_chars, target_chars=target_chars)).otherwise(F.array("__text"))
    df = computed(df, __parts=parts)
    df = df.select("page_url", "page_title", "page_h1", "section_id", F.col("heading_path").alias("section_path"), F.col("heading_text").alias("section_heading"), F.col("heading_level").alias("section_heading_level"), F.col("order").alias("section_order"), F.length("__text").alias("__n"), F.posexplode("__parts").alias("part", "chunk_text"))
    n = F.length("chunk_text")
    warnings = F.when(F.col("__n") <= max_chars, F.when(F.col("__n") < SHORT_SECTION, F.array(F.lit("short_section"))).otherwise(F.array().cast("array<string>"))).otherwise(F.when(n > max_chars, F.array(F.lit("split_long_section"), F.lit("oversized_chunk"))).otherwise(F.array(F.lit("split_long_section"))))
    order = W.partitionBy("page_url").orderBy("section_order", "part")
    return df.select(
        F.format_string("%s:%s:%03d", tx.safe_id(F.col("page_url")), tx.safe_id(F.col("section_id")), F.col("part")).alias("chunk_id"),
        "page_url", "page_title", "page_h1", "section_id", "section_path", "section_heading", "section_heading_level", "section_order", "part", "chunk_text",
        (F.row_number().over(order) - 1).alias("chunk_order"), tx.token_estimate(F.col("chunk_text")).alias("token_estimate"), n.alias("text_length"), warnings.alias("warnings"),
    )


def documents_as_pages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents in the form of pages: one section for each line that is not blank."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), tx.normalize_whitespace), lambda x: x != "")
    section = F.transform(lines, lambda x, i: F.struct(F.format_string("section-%03d", i).alias("section_id"), F.array(F.lit("Page Content")).alias("heading_path"), F.lit(None).cast("int").alias("heading_level"), F.lit("Page Content").alias("heading_text"), x.alias("text"), i.alias("order"), F.lit(None).cast("string").alias("source_selector")))
    df = docs.select(F.concat(F.lit("doc://"), F.col(doc_id)).alias("url"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("h1"), section.alias("sections"))
    return df.withColumn("text_char_count", F.aggregate("sections", F.lit(0), lambda a, s: a + F.length(s["text"])))
