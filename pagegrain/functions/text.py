"""Text expressions: white space, tokens, blocks, snippets, word sets.

All are JVM-side columns.  White space means what Python's ``\\s`` means, not Java's ASCII class.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java class of Python's white space.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: The same for DuckDB (RE2).
SPACE_RE2 = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def normalize_whitespace(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def has_letters(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def token_estimate(text: Column) -> Column:
    """A quarter of the normalised length, rounded half to even, at least 1; 0 for blank and null texts."""
    n = F.coalesce(F.length(normalize_whitespace(text)), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(n / F.lit(4.0), 0).cast("int"))).cast("int")


def _clean(parts: Column) -> Column:
    return F.filter(F.transform(parts, normalize_whitespace), lambda x: x != "")


def sentences(text: Column) -> Column:
    return _clean(F.split(text, rf"(?<=[.!?]){SPACE}+", -1))


def plain_sentences(normalized: Column) -> Column:
    """Sentences of a text that is normalised already: nothing is left to normalise in them."""
    return F.filter(F.split(normalized, r"(?<=[.!?]) +", -1), lambda x: x != "")


def text_blocks(text: Column) -> Column:
    """Paragraphs between blank lines if there are several, else lines, else sentences."""
    paragraphs = _clean(F.split(text, rf"\n{SPACE}*\n+", -1))
    lines = _clean(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1))
    return F.when(F.size(paragraphs) > 1, paragraphs).when(F.size(lines) > 1, lines).otherwise(sentences(text))


def shorten(normalized: Column, limit: int = 220) -> Column:
    """A normalised text, or its first ``limit - 3`` characters without space at the end and three dots."""
    return F.when(F.length(normalized) <= limit, normalized).otherwise(F.concat(F.rtrim(F.substring(normalized, 1, limit - 3)), F.lit("...")))


def snippet(text: Column, limit: int = 220) -> Column:
    return shorten(normalize_whitespace(text), limit)


def repetition_key(normalized: Column) -> Column:
    """Lower case, with nothing but a-z, 0-9 and spaces, of a normalised text."""
    return F.regexp_replace(F.lower(normalized), "[^a-z0-9 ]+", "")


def content_words(text: Column) -> Column:
    """Distinct words of a-z and 0-9 with three characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(normalize_whitespace(text)), F.lit("[a-z0-9]+"), 0), lambda w: F.length(w) > 2))


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of two word sets, 0 if one is empty."""
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(F.size(F.array_intersect(left, right)) / F.size(F.array_union(left, right)))


def safe_id(text: Column) -> Column:
    """Lower case; all but letters, digits, ``-``, ``_`` and ``.`` as single hyphens, none at the ends."""
    t = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_.-]", "-")
    t = F.regexp_replace(F.regexp_replace(t, "^-+|-+$", ""), "-{2,}", "-")
    return F.when(t == "", "item").otherwise(t)


def contains_any(text: Column, phrases) -> Column:
    """Whether one of the phrases is a substring."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out
