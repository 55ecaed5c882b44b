"""Fetch sources: snapshots of responses, live HTTP, and their classification."""

from __future__ import annotations

import time
import urllib.error
import urllib.request

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls

RESULT = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("final_url", T.StringType()), T.StructField("status", T.StringType()), T.StructField("ok", T.BooleanType()), T.StructField("status_code", T.IntegerType()),
    T.StructField("content_type", T.StringType()), T.StructField("html", T.StringType()), T.StructField("error", T.StringType()), T.StructField("elapsed_ms", T.DoubleType()),
])
ACCEPT = "text/html,application/xhtml+xml"
NOT_HTML = "Response content type is not HTML."


def clean_content_type(raw: Column) -> Column:
    """Media type without parameters, lower-cased; null for an empty header."""
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit(None).cast("string")).otherwise(F.lower(F.trim(F.substring_index(raw, ";", 1))))


def is_html(content_type: Column, body: Column) -> Column:
    """By media type; without one, by how the body begins."""
    begin = F.lower(F.regexp_replace(F.coalesce(body, F.lit("")), r"^[\s\p{Z}]+", ""))
    return F.coalesce(content_type.isin("text/html", "application/xhtml+xml"), begin.rlike(r"^(<!doctype html|<html)"))


def classify(responses: DataFrame, *, rendered: bool = False) -> DataFrame:
    """RESULT of responses (url, status_code, content_type, body, and final_url, error or elapsed_ms if there).

    A response with an error is a network error.  Plain responses must have status 200; rendered ones
    fail from 400 on, and count as HTML without a content type.
    """
    for name, kind in (("final_url", "string"), ("error", "string"), ("elapsed_ms", "double")):
        if name not in responses.columns:
            responses = responses.withColumn(name, F.lit(None).cast(kind))
    kind = clean_content_type(F.col("content_type"))
    if rendered:
        kind = F.coalesce(kind, F.lit("text/html"))
    code = F.col("status_code")
    refused = (code >= 400) if rendered else (code != 200)
    failed = F.col("error").isNotNull()
    status = F.when(failed, "network_error").when(F.coalesce(refused, F.lit(True)), "http_error").when(~is_html(kind, F.col("body")), "non_html").otherwise("success")
    df = responses.select("url", F.when(~failed, F.coalesce("final_url", "url")).alias("final_url"), status.alias("status"), code.cast("int").alias("status_code"), F.when(~failed, kind).alias("content_type"), "body", F.col("error").alias("__error"), F.col("elapsed_ms").cast("double").alias("elapsed_ms"))
    ok = F.col("status") == "success"
    error = F.when(F.col("status") == "network_error", F.col("__error")).when(F.col("status") == "http_error", F.concat(F.lit("Unexpected HTTP status "), F.coalesce(F.col("status_code").cast("string"), F.lit("none")), F.lit("."))).when(F.col("status") == "non_html", NOT_HTML)
    return df.select("url", "final_url", "status", ok.alias("ok"), "status_code", "content_type", F.when(ok, F.col("body")).alias("html"), error.alias("error"), "elapsed_ms")


def snapshot(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """A table of pages as fetch results, by canonical URL; pages of one URL: the first of the smallest raw URL."""
    canon = urls.canonical_url(F.col(url))["url"]
    df = pages.select(canon.alias("url"), F.col(url).alias("__raw"), F.col(html).alias("body")).where("url is not null")
    df = df.groupBy("url").agg(F.min(F.struct("__raw", "body")).alias("x")).select("url", F.col("x.body").alias("body"))
    return classify(df.select("url", F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"), "body"))


def lookup(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """Fetch results of ``wanted`` (url, and whatever else); a URL that is not in the results is a 404."""
    own = [F.col(f"`{c}`") for c in wanted.columns]
    got = results.select(F.col("url").alias("__url"), *[c for c in RESULT.names if c != "url"])
    missing = F.col("__url").isNull()
    df = wanted.join(got, F.col("url") == F.col("__url"), "left")
    return df.select(*own, "final_url", F.when(missing, "http_error").otherwise(F.col("status")).alias("status"), F.coalesce("ok", F.lit(False)).alias("ok"), F.when(missing, 404).otherwise(F.col("status_code")).cast("int").alias("status_code"), "content_type", "html", F.when(missing, "Unexpected HTTP status 404.").otherwise(F.col("error")).alias("error"), "elapsed_ms")


def live(wanted: DataFrame, *, timeout: float = 20.0, user_agent: str = "pagegrain") -> DataFrame:
    """Fetch URLs over HTTP from the executors, a request per row; redirects are followed."""
    raw = T.StructType([T.StructField("url", T.StringType()), T.StructField("final_url", T.StringType()), T.StructField("status_code", T.IntegerType()), T.StructField("content_type", T.StringType()), T.StructField("body", T.StringType()), T.StructField("error", T.StringType()), T.StructField("elapsed_ms", T.DoubleType())])

    def get(url: str) -> tuple:
        begin = time.perf_counter()
        try:
            request = urllib.request.Request(url, headers={"Accept": ACCEPT, "User-Agent": user_agent})
            try:
                response = urllib.request.urlopen(request, timeout=timeout)
            except urllib.error.HTTPError as e:
                response = e
            with response as r:
                body = r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
                found = (r.url, r.status, r.headers.get("content-type"), body, None)
        except TimeoutError as e:
            found = (None, None, None, None, f"Request timed out: {e}")
        except ValueError as e:
            found = (None, None, None, None, f"Invalid URL: {e}")
        except OSError as e:
            found = (None, None, None, None, f"Network error: {e}")
        return (url, *found, round((time.perf_counter() - begin) * 1000, 3))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([get(u) for u in pdf["url"]], columns=raw.names).astype({"status_code": "Int32"})

    got = classify(wanted.select("url").distinct().mapInPandas(run, raw))
    kind = F.when(F.startswith("error", F.lit("Request timed out")), "timeout").when(F.startswith("error", F.lit("Invalid URL")), "invalid_url").otherwise(F.col("status"))
    return got.withColumn("status", kind)
