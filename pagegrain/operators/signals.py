"""Deterministic quality signals of pages and their chunks.

Every page is judged inside its own row: each generator is an array expression, the arrays are joined in a
fixed order and exploded, so ``signal_ord`` needs no window and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..functions.barrier import computed

# Fixed values.
THIN_PAGE, MIN_SECTIONS, THIN_SECTION, DENSE_SECTION, LONG_PARAGRAPH, TRUST_MIN, REPEAT_MIN = 300, 2, 120, 2200, 700, 180, 45
CTA_PHRASES = ("book a demo", "buy now", "call us", "contact us", "download", "get a quote", "get started", "request a demo", "schedule", "sign up", "start free", "start trial", "subscribe", "try free")
GENERIC_CTA = ("click here", "get started", "learn more", "read more", "submit")
VAGUE = ("best-in-class", "cutting-edge", "end-to-end solutions", "game-changing", "innovative solutions", "next-generation", "seamless experience", "state-of-the-art", "world-class")
COMMERCIAL = ("business", "customer", "customers", "feature", "features", "plan", "plans", "pricing", "product", "products", "service", "services", "solution", "solutions")
COMMERCIAL_PATHS = ("features", "pricing", "product", "products", "service", "services", "solutions")
TRUST = ("address", "award", "case study", "certified", "client", "client review", "client reviews", "clients", "contact", "customer", "customer review", "customer reviews", "customers", "email", "guarantee", "phone", "privacy", "secure", "testimonial", "testimonials", "trusted", "years")
WEAK_HEADINGS = ("about", "content", "features", "home", "intro", "overview", "services", "solutions", "welcome")
KINDS = {
    "thin_page": ("medium", 0.82, "Page has very limited extracted text for a useful content audit."),
    "weak_structure": ("low", 0.72, "Page has very few meaningful sections, which may limit scanability."),
    "thin_section": ("low", 0.78, "Section has very little text and may need more context."),
    "dense_section": ("medium", 0.76, "Section is long and may need clearer substructure."),
    "long_paragraph": ("medium", 0.8, "A paragraph-like block is long and may be hard to scan."),
    "weak_heading": ("low", 0.7, "Section heading may be missing or too generic."),
    "oversized_chunk": ("medium", 0.74, "Chunk is still large after splitting and may need smaller source sections."),
    "missing_cta": ("medium", 0.72, "Important-looking commercial page may lack a clear call to action."),
    "generic_cta": ("low", 0.68, "CTA phrasing appears generic and may need more specific intent."),
    "missing_trust_indicators": ("medium", 0.66, "Commercial page mentions offerings but may lack obvious trust or credibility cues."),
    "vague_marketing_language": ("low", 0.7, "Page uses broad marketing phrases that may need concrete proof."),
    "repeated_heading": ("low", 0.84, "Same heading text appears multiple times on the page."),
    "repeated_phrase": ("low", 0.76, "A sentence or phrase appears repeatedly within the same page."),
}


def _signal(kind: str, *, evidence: Column | None = None, section: Column | None = None, chunk: Column | None = None, **metadata: Column) -> Column:
    severity, confidence, message = KINDS[kind]
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("signal_type"), (none if section is None else section).alias("section_id"), (none if chunk is None else chunk).alias("chunk_id"),
        F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), F.lit(message).alias("message"),
        (none if evidence is None else F.when(evidence == "", none).otherwise(tx.shorten(evidence))).alias("evidence_snippet"),
        (F.to_json(F.struct(*[v.alias(k) for k, v in metadata.items()])) if metadata else F.lit("{}")).alias("metadata"),
    )


def _some(*pairs: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(test, signal) for test, signal in pairs]))


def _section(s: Column) -> Column:
    """What is needed of a section, normalised once."""
    t = tx.normalize_whitespace(F.coalesce(s["text"], F.lit("")))
    blocks = F.filter(F.transform(F.split(s["text"], rf"\n{tx.SPACE}*\n+", -1), tx.normalize_whitespace), lambda b: b != "")
    return F.struct(s["section_id"].alias("id"), t.alias("t"), tx.normalize_whitespace(F.coalesce(s["heading_text"], F.lit(""))).alias("heading"), F.when(s["text"].rlike(rf"\n{tx.SPACE}*\n"), blocks).otherwise(F.array(t)).alias("blocks"))


def _of_section(s: Column) -> Column:
    t, heading, n = s["t"], s["heading"], F.length(s["t"])
    long = F.get(F.filter(s["blocks"], lambda b: F.length(b) > LONG_PARAGRAPH), F.lit(0))
    found = _some(
        (n < THIN_SECTION, _signal("thin_section", evidence=t, section=s["id"], text_length=n)),
        (n > DENSE_SECTION, _signal("dense_section", evidence=t, section=s["id"], text_length=n)),
        (long.isNotNull(), _signal("long_paragraph", evidence=long, section=s["id"], paragraph_length=F.length(long))),
        ((F.lower(heading).isin(*WEAK_HEADINGS)) | (F.length(heading) < 4), _signal("weak_heading", evidence=heading, section=s["id"], heading_text=F.when(heading != "", heading))),
    )
    return F.when(t == "", F.array().cast(_ARRAY)).otherwise(found)


_ARRAY = "array<struct<signal_type:string,section_id:string,chunk_id:string,severity:string,confidence:double,message:string,evidence_snippet:string,metadata:string>>"


def _with_repeated(df: DataFrame, keys: str, name: str) -> DataFrame:
    """``df`` with the distinct non-empty keys that occur more than once, in order of first occurrence."""
    df = computed(df, __s=F.sort_array(keys))
    df = computed(df, __t=F.array_distinct(F.filter("__s", lambda k, i: (i > 0) & (F.get(F.col("__s"), i - 1) == k))))
    return computed(df, **{name: F.filter(F.array_distinct(keys), lambda k: (k != "") & F.array_contains(F.col("__t"), k))}).drop("__s", "__t")


def page_signals(pages: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Signals of pages (url, title, h1, text_char_count, sections): page_url, signal_ord and the signal.

    chunks: of the same pages, for ``oversized_chunk``; only chunks with that warning are grouped by page.
    """
    df = pages.select("url", F.coalesce("title", F.lit("")).alias("__title"), F.coalesce("h1", F.lit("")).alias("__h1"), "text_char_count", F.coalesce("sections", F.array().cast(pages.schema["sections"].dataType)).alias("sections"))
    df = computed(df, __secs=F.transform("sections", _section)).drop("sections")
    df = computed(df, __full=F.array_join(F.filter(F.transform("__secs", lambda s: s["t"]), lambda t: t != ""), " "))
    if chunks is not None:
        big = chunks.where(F.array_contains("warnings", "oversized_chunk")).groupBy(F.col("page_url").alias("url")).agg(F.sort_array(F.collect_list(F.struct("chunk_order", "chunk_id", "section_id", "chunk_text", "text_length"))).alias("__big"))
        df = df.join(big, "url", "left")
        over = F.coalesce(F.transform("__big", lambda c: _signal("oversized_chunk", evidence=c["chunk_text"], section=c["section_id"], chunk=c["chunk_id"], text_length=c["text_length"])), F.array().cast(_ARRAY))
    else:
        over = F.array().cast(_ARRAY)
    cand = F.filter(F.flatten(F.transform("__secs", lambda s: tx.plain_sentences(s["t"]))), lambda x: F.length(x) >= REPEAT_MIN)
    heads = F.transform(F.filter("__secs", lambda s: s["heading"] != ""), lambda s: tx.repetition_key(s["heading"]))
    df = computed(df, __low=F.lower("__full"), __cand=cand, __titles=heads)
    df = computed(df, __keys=F.transform("__cand", tx.repetition_key))
    df = _with_repeated(_with_repeated(df, "__titles", "__heads"), "__keys", "__again")
    df = computed(df, __phrases=F.filter("__cand", lambda c, i: F.array_contains(F.col("__again"), F.get(F.col("__keys"), i))))
    low, full = F.col("__low"), F.col("__full")
    commercial = F.arrays_overlap(urls.segments(F.col("url")), F.array(*map(F.lit, COMMERCIAL_PATHS))) | tx.contains_any(F.lower(F.concat_ws(" ", F.when(F.col("__title") != "", F.col("__title")), F.when(F.col("__h1") != "", F.col("__h1")), F.substring(full, 1, 1000))), COMMERCIAL)
    real = F.size(F.filter("__secs", lambda s: s["t"] != ""))
    generic = F.get(F.filter(F.array(*map(F.lit, sorted(GENERIC_CTA))), lambda p: F.contains(low, p)), F.lit(0))
    vague = F.filter(F.array(*map(F.lit, sorted(VAGUE))), lambda p: F.contains(low, p))
    found = F.concat(
        _some((F.col("text_char_count") < THIN_PAGE, _signal("thin_page", evidence=full, text_char_count=F.col("text_char_count"))), (real < MIN_SECTIONS, _signal("weak_structure", section_count=real))),
        F.flatten(F.transform("__secs", _of_section)),
        over,
        _some((commercial & ~tx.contains_any(low, CTA_PHRASES), _signal("missing_cta", evidence=full, page_kind=F.lit("commercial_or_conversion"))), (generic.isNotNull(), _signal("generic_cta", evidence=generic, phrase=generic))),
        _some((commercial & (F.length(full) >= TRUST_MIN) & ~tx.contains_any(low, TRUST), _signal("missing_trust_indicators", evidence=full, checked_terms=F.array(*map(F.lit, sorted(TRUST)))))),
        _some((F.size(vague) > 0, _signal("vague_marketing_language", evidence=F.get(vague, F.lit(0)), phrases=vague))),
        _some((F.size("__heads") > 0, _signal("repeated_heading", evidence=F.get("__heads", F.lit(0)), headings=F.col("__heads"))), (F.size("__phrases") > 0, _signal("repeated_phrase", evidence=F.get("__phrases", F.lit(0)), phrases=F.slice("__phrases", 1, 5)))),
    )
    df = computed(df, __found=found).select(F.col("url").alias("page_url"), "__found")
    return df.select("page_url", F.posexplode("__found").alias("signal_ord", "s")).select("page_url", "signal_ord", "s.*")


def signal_counts(signals: DataFrame, by: str = "signal_type") -> DataFrame:
    """Signals of each page by type or severity, with the place of the first."""
    return signals.groupBy("page_url", by).agg(F.count(F.lit(1)).alias("n"), F.min("signal_ord").alias("first_ord"))
