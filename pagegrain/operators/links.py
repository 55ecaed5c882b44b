"""Links of pages: extraction, filter with reasons, crawl priority."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls

# Fixed values.
ASSET_EXTENSIONS = "7z avi bmp css csv doc docx eot gif gz ico jpeg jpg js json m4a m4v mov mp3 mp4 mpeg mpg ogg otf pdf png ppt pptx rar rss svg tar tif tiff ttf txt wav webm webp woff woff2 xls xlsx xml zip".split()
LOW_VALUE_SEGMENTS = "account accounts admin basket cart categories category checkout dashboard login log-in logout register search sign-in sign-up signin signup tag tags user users wp-admin".split()
LOW_VALUE_KEYS = ("replytocom", "share", "print")
MAX_QUERY_PARAMS = 4
IMPORTANT_PATHS = (("pricing", 120), ("about", 110), ("service", 105), ("services", 105), ("product", 100), ("products", 100), ("features", 95), ("docs", 90), ("documentation", 90), ("faq", 85), ("testimonials", 80), ("case-studies", 75), ("contact", 70), ("blog", 45))
HOMEPAGE_PRIORITY = 1000


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            href = dict(attrs).get("href")
            if href:
                self.found.append(href)

    handle_startendtag = handle_starttag


def anchors(html: str | None) -> list[str]:
    """Non-empty href values of all anchors, in document order, with repeats."""
    p = _Anchors()
    p.feed(html or "")
    p.close()
    return p.found


@F.pandas_udf(T.ArrayType(T.StringType()))
def _anchors(html: pd.Series) -> pd.Series:
    return html.map(anchors)


def extract_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per link: the columns of ``pages`` but the HTML, ``pos`` and ``href``."""
    own = [F.col(f"`{c}`") for c in pages.columns if c != html]
    return pages.select(*own, F.posexplode(_anchors(F.col(html))).alias("pos", "href"))


def is_asset(url: Column) -> Column:
    return F.lower(urls.path_of(url)).rlike(r"\.(" + "|".join(ASSET_EXTENSIONS) + ")$")


def _parameters(url: Column) -> Column:
    """Names and values of a canonical query."""
    return F.filter(F.split(urls.query_of(url), "&", -1), lambda x: x != "")


def is_low_value(url: Column) -> Column:
    """Account, listing, print and paging URLs, and those with more than four parameters."""
    own, params = urls.segments(url), _parameters(url)
    names = F.transform(params, lambda p: F.lower(F.substring_index(p, "=", 1)))
    joined = F.concat(F.lit("/"), F.array_join(own, "/"))
    paging = F.exists(params, lambda p: F.lower(p).rlike(r"^paged?=0*([2-9]|[1-9]\d+)$"))
    return (
        F.arrays_overlap(own, F.array(*map(F.lit, LOW_VALUE_SEGMENTS)))
        | joined.rlike(r"/page/\d+$")
        | joined.rlike(r"/p(age)?-?\d+$")
        | (F.size(params) > MAX_QUERY_PARAMS)
        | F.arrays_overlap(names, F.array(*map(F.lit, LOW_VALUE_KEYS)))
        | paging
    )


def filter_links(links: DataFrame, *, href: str = "href", base_url: str = "base_url", site_root: str = "site_root", seen: DataFrame | None = None) -> DataFrame:
    """``links`` with allowed, reason and normalized_url; the first reason that holds decides.

    seen: canonical URLs (column ``url``) known before.
    """
    raw = F.trim(F.regexp_replace(F.coalesce(F.col(href), F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    df = links.withColumn("__c", urls.canonical_url(F.col(href), F.col(base_url)))
    if seen is not None:
        known = seen.select(F.col("url").alias("__seen")).distinct()
        df = df.join(known, F.col("__c.url") == F.col("__seen"), "left")
    else:
        df = df.withColumn("__seen", F.lit(None).cast("string"))
    url = F.col("__c.url")
    reason = (
        F.when(raw == "", "empty_link")
        .when(F.startswith(raw, F.lit("#")), "fragment_only")
        .when(F.lower(raw).rlike("^(mailto|tel|javascript):"), "blocked_scheme")
        .when(url.isNull(), "invalid_url")
        .when(~urls.same_domain(url, F.col(site_root)), "external_domain")
        .when(is_asset(url), "non_html_asset")
        .when(is_low_value(url), "low_value_path")
        .when(F.col("__seen").isNotNull(), "duplicate_url")
        .otherwise("accepted")
    )
    early = reason.isin("empty_link", "fragment_only", "blocked_scheme", "invalid_url")
    own = [F.col(f"`{c}`") for c in links.columns]
    return df.select(*own, (reason == "accepted").alias("allowed"), reason.alias("reason"), F.when(~early, url).alias("normalized_url"))


def priority(url: Column, root: Column) -> tuple[Column, Column]:
    """(score, reason) of a canonical URL in the crawl order."""
    path = F.regexp_replace(F.lower(urls.path_of(url)), "^/+|/+$", "")
    best, word = F.lit(0), F.lit(None).cast("string")
    for name, weight in sorted(reversed(IMPORTANT_PATHS), key=lambda x: x[1]):  # the heaviest test, of equals the first listed, comes last and so decides
        hit = F.contains(path, F.lit(name))
        best, word = F.when(hit, weight).otherwise(best), F.when(hit, name).otherwise(word)
    score = F.greatest(F.lit(0), 10 + best - 8 * F.greatest(urls.path_depth(url) - 1, F.lit(0)) - F.when(urls.query_of(url) != "", 10).otherwise(0))
    home = url == root
    return F.when(home, HOMEPAGE_PRIORITY).otherwise(score).cast("int"), F.when(home, "homepage").when(word.isNotNull(), F.concat(F.lit("important_path:"), word)).otherwise("standard_page")
