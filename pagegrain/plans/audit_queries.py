"""Queries over inline rows (audit vocabulary does not occur in the tables) and over ``events`` as a job log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import aggregate, audit, crawl, model_output, signals
from ..sources import fetch, jobs
from .registry import query, table, values

URL_CASES = [
    (1, " Example.com/a/ ", None, "https://example.com/a", None),
    (2, "HTTP://WWW.Example.COM:80/x//y/?b=2&a=1&utm_source=n#f", None, "http://www.example.com/x/y?a=1&b=2", None),
    (3, "../x/#y", "https://example.com/docs/a", "https://example.com/x", None),
    (4, "//cdn.example.com/z", None, "https://cdn.example.com/z", None),
    (5, "mailto:a@b.c", None, None, urls.SCHEME),
    (6, "", None, None, urls.EMPTY),
    (7, "ftp://example.com/f", None, None, urls.NOT_HTTP),
    (8, "https://example.com:bad/", None, None, urls.BAD_PORT),
    (9, "https://example.com:8443/p q/%7Eu?k=&k=1", None, "https://example.com:8443/p%20q/~u?k=&k=1", None),
    (10, "http://[::1", None, None, urls.MALFORMED),
    (11, "https://user:pw@example.com/%E9", None, "https://example.com/%EF%BF%BD", None),
    (12, "https://example.com/?gclid=1&fbclid=2", None, "https://example.com/", None),
    (13, None, None, None, urls.EMPTY),
]


@query("SELECT id, normalized_url, error FROM " + values([(r[0], r[3], r[4]) for r in URL_CASES], "id, normalized_url, error"))
def url_cases(spark, sf_dir):
    df = spark.createDataFrame([r[:3] for r in URL_CASES], "id int, url string, base string")
    c = urls.canonical_url(F.col("url"), F.col("base"))
    return df.select("id", c.alias("c")).select("id", F.col("c.url").alias("normalized_url"), F.col("c.error").alias("error"))


SIGNAL_PAGES = [
    ("https://e.com/pricing", "Pricing", "Our plans", "Overview", "We have innovative solutions and a seamless experience for everybody who works here. " * 4),
    ("https://e.com/docs", "Guide", "Guide", "Install", "Read the manual, then run the program and look at the screen until it ends. Click here for more of it."),
    ("https://e.com/a", "Our products", "Things", "FAQ", "Contact us about products. Trusted by clients for years, learn more about it and get started today with our friendly people in town."),
    ("https://e.com/services/x", "X", "X", "X", "Short text."),
    ("https://e.com/b", "Business", "B", "Welcome", "World-class things with a guarantee; download it. " * 5),
]
_L = "lower(txt)"
_any = lambda words, text=_L: "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"
_COMM = f"(list_has_any(string_split(regexp_extract(url, '^https?://[^/]*/(.*)$', 1), '/'), [{', '.join(repr(x) for x in signals.COMMERCIAL_PATHS)}]) OR {_any(signals.COMMERCIAL, _L.replace('txt', 'concat(title, chr(32), h1, chr(32), txt)'))})"
_GEN = "CASE " + " ".join(f"WHEN contains({_L}, '{w}') THEN '{w}'" for w in sorted(signals.GENERIC_CTA)) + " END"
_VAG = "CASE " + " ".join(f"WHEN contains({_L}, '{w}') THEN '{w}'" for w in sorted(signals.VAGUE)) + " END"


@query(f"""WITH p AS (SELECT url, title, h1, heading, trim(txt) AS txt FROM {values(SIGNAL_PAGES, 'url, title, h1, heading, txt')}),
s AS (SELECT url, 'missing_cta' AS signal_type, CASE WHEN length(txt) <= 220 THEN txt ELSE concat(rtrim(substring(txt, 1, 217)), '...') END AS evidence FROM p WHERE {_COMM} AND NOT {_any(signals.CTA_PHRASES)}
UNION ALL SELECT url, 'generic_cta', {_GEN} FROM p WHERE {_GEN} IS NOT NULL
UNION ALL SELECT url, 'missing_trust_indicators', CASE WHEN length(txt) <= 220 THEN txt ELSE concat(rtrim(substring(txt, 1, 217)), '...') END FROM p WHERE {_COMM} AND length(txt) >= {signals.TRUST_MIN} AND NOT {_any(signals.TRUST)}
UNION ALL SELECT url, 'vague_marketing_language', {_VAG} FROM p WHERE {_VAG} IS NOT NULL
UNION ALL SELECT url, 'weak_heading', heading FROM p WHERE lower(heading) IN ({', '.join(repr(w) for w in signals.WEAK_HEADINGS)}) OR length(heading) < 4)
SELECT * FROM s""")
def vocabulary_signals(spark, sf_dir):
    df = spark.createDataFrame(SIGNAL_PAGES, "url string, title string, h1 string, heading string, txt string")
    section = F.struct(F.lit("section-000").alias("section_id"), F.array("heading").alias("heading_path"), F.lit(2).alias("heading_level"), F.col("heading").alias("heading_text"), F.trim("txt").alias("text"), F.lit(0).alias("order"), F.lit(None).cast("string").alias("source_selector"))
    pages = df.select("url", "title", "h1", F.length(F.trim("txt")).alias("text_char_count"), F.array(section).alias("sections"))
    kinds = ("missing_cta", "generic_cta", "missing_trust_indicators", "vague_marketing_language", "weak_heading")
    return signals.page_signals(pages).where(F.col("signal_type").isin(*kinds)).select(F.col("page_url").alias("url"), "signal_type", F.col("evidence_snippet").alias("evidence"))


CATEGORY_TEXTS = [(i, t) for i, t in enumerate(("Fix the spelling here", "Add a button", "Split this section", "It repeats itself", "No proof given", "Readers lose interest", "Voice is off", "Too dense", "Explain more", "Unclear and vague", "Something else", "The heading has a typo"))]
_CAT = "CASE " + " ".join(f"WHEN {_any(words, 'lower(t)')} THEN '{n}'" for n, words in model_output.CATEGORY_WORDS) + " ELSE 'other' END"


@query(f"SELECT id, {_CAT} AS category FROM {values(CATEGORY_TEXTS, 'id, t')}")
def infer_category(spark, sf_dir):
    return spark.createDataFrame(CATEGORY_TEXTS, "id int, t string").select("id", model_output.infer_category(F.col("t")).alias("category"))


ANSWERS = [
    ("a", 0, '{"improvements": [{"category": "clarity", "issue": " Vague  claim ", "suggested_change": "Say how", "reason": "r", "severity": "HIGH", "confidence": 0.9, "evidence_snippet": "x"}]}', None),
    ("b", 0, 'Sure: {"improvements": [{"issue": "Add a button {now}", "suggested_change": "Do", "reason": "r", "confidence": 0.99, "category": "clarity|tone"}]} ok', None),
    ("c", 0, '[{"issue": "The text is clear", "suggested_change": "s", "reason": "r"}, 3, {"issue": "", "suggested_change": "s", "reason": "r"}]', None),
    ("d", 0, "no json", None), ("d", 1, '{"improvements": [{"issue": "Typo", "suggested_change": "s", "reason": "r", "confidence": "7", "rewrite_example": "e"}]}', None),
    ("e", 0, "{bad", None), ("e", 1, "[1, 2", None),
    ("f", 0, None, "offline"),
    ("g", 0, '{"improvements": [{"issue": 5, "suggested_change": "s", "reason": "r"}]}', None), ("g", 1, None, "timeout"),
    ("h", 0, '{"improvements": [{"issue": "Heading", "suggested_change": "s", "reason": "r", "confidence": true, "severity": "x"}], "missing_content": [{"missing_content": "A", "suggestion": "a", "reason": "r"}]}', None),
]
ANSWER_CHUNKS = [c for c in "abcdefghi"]


def _analysis(spark):
    chunks = spark.createDataFrame([(c, "https://e.com/", "section-000", ["S"]) for c in ANSWER_CHUNKS], "chunk_id string, page_url string, section_id string, section_path array<string>")
    return model_output.analyze(chunks, spark.createDataFrame(ANSWERS, audit.OUTPUT))


@query("SELECT * FROM " + values([
    ("a", "clarity", "Vague claim", "high", 0.9, None), ("b", "cta", "Add a button {now}", "medium", 0.75, None), ("d", "other", "Typo", "medium", 0.75, "e"), ("h", "other", "Heading", "medium", 0.75, None),
], "chunk_id, category, issue, severity, confidence, example_text"))
def clean_improvements(spark, sf_dir):
    return _analysis(spark).select("chunk_id", F.inline("improvements")).select("chunk_id", "category", "issue", "severity", "confidence", "example_text")


@query("SELECT * FROM " + values([
    ("b", "normalized_copied_category_list"), ("c", "dropped_improvement_without_clear_issue"), ("c", "dropped_improvement_missing_required_text"), ("e", "invalid_llm_json"), ("f", "provider_error"),
    ("g", "json_repair_provider_error"), ("h", "dropped_missing_content_duplicate_suggestion"), ("i", "provider_error"),
], "chunk_id, warning"))
def answer_warnings(spark, sf_dir):
    return _analysis(spark).select("chunk_id", F.explode("warnings").alias("w")).select("chunk_id", F.substring_index("w", ":", 1).alias("warning"))


RECS = [("p", i, c, f"Issue {k}", f"Change {k}", s, x) for i, (c, k, s, x) in enumerate([
    ("cta", 1, "high", 0.5), ("cta", 1, "low", 0.7), ("cta", 1, "high", 0.7), ("trust", 2, "medium", 0.9), ("tone", 3, "medium", 0.9), ("tone", 4, "info", 1.0), ("clarity", 5, "high", 0.7), ("structure", 6, "low", 0.3), ("cta", 2, "medium", 0.2),
])] + [("q", i, "clarity", f" issue   {i % 14}", "Do it", "medium", i / 32) for i in range(16)]


@query(f"""WITH r AS (SELECT *, concat(lower(category), '|', lower(trim(regexp_replace(issue, '\\s+', ' ', 'g'))), '|', lower(change)) AS k FROM {values(RECS, 'page_url, rec_ord, category, issue, change, severity, confidence')}),
b AS (SELECT *, row_number() OVER (PARTITION BY page_url, k ORDER BY confidence DESC, rec_ord) AS n, min(rec_ord) OVER (PARTITION BY page_url, k) AS f FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY page_url ORDER BY CASE severity WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END DESC, confidence DESC, f) AS place FROM b WHERE n = 1)
SELECT page_url, CAST(rec_ord AS INTEGER) AS rec_ord, issue, severity, confidence, CAST(place AS INTEGER) AS place FROM o WHERE place <= {aggregate.MAX_IMPROVEMENTS}""")
def dedupe_improvements(spark, sf_dir):
    """Best of equal recommendations, ranked and capped per page."""
    df = spark.createDataFrame(RECS, "page_url string, rec_ord int, category string, issue string, suggested_change string, severity string, confidence double")
    return aggregate.dedupe_improvements(df).where(F.col("place") <= aggregate.MAX_IMPROVEMENTS).select("page_url", "rec_ord", "issue", "severity", "confidence", "place")


SCORES = [(i, t, c, s, x, m) for i, (t, c, s, x, m) in enumerate([("homepage", "cta", "high", 0.9, "missing_cta"), ("pricing", "trust", "medium", 0.62, "vague_marketing_language"), ("blog", "tone", "low", 0.33, ""), ("services_product", "missing_context", "high", 0.71, "thin_page"), ("faq", "duplication", "info", 0.11, "dense_section"), ("homepage", "trust", "high", 1.0, "missing_trust_indicators")])]
_map = lambda d, k: "CASE " + k + " " + " ".join(f"WHEN '{a}' THEN CAST({b} AS DOUBLE)" for a, b in d.items())
_SUP = "CASE " + " ".join(f"WHEN category = '{k}' AND signal IN ({', '.join(repr(x) for x in v)}) THEN 1" for k, v in aggregate.SUPPORT.items()) + " ELSE 0 END"


@query(f"""SELECT id, round(least(100.0, {_map(aggregate.POINTS, 'severity')} ELSE 10 END + confidence * 12 + {_map(aggregate.PAGE_BONUS, 'page_type')} ELSE 0 END + {_map(aggregate.CATEGORY_BONUS, 'category')} ELSE 1 END + least(4.0 * {_SUP}, 8.0)), 1) AS priority_score FROM {values(SCORES, 'id, page_type, category, severity, confidence, signal')}""")
def priority_score(spark, sf_dir):
    df = spark.createDataFrame(SCORES, "id int, page_type string, category string, severity string, confidence double, signal string").withColumn("signal_types", F.array("signal"))
    return aggregate.recommendation_priority(df, level="severity").select("id", "priority_score")


def site_page(title: str, body: str, *hrefs: str) -> str:
    links = "".join(f'<a href="{h}">{h}</a> ' for h in hrefs)
    return f"<html><head><title>{title}</title></head><body><nav>menu</nav><main><h1>{title} page</h1><p>{body}</p>{links}</main></body></html>"


SITE = [
    ("https://s.test/", site_page("Home", "Welcome to the site of this company, which is here.", "/blog", "/login", "/a.pdf", "https://other.test/", "/pricing", "about?utm_source=x", "/blog")),
    ("https://s.test/blog", site_page("Blog", "Posts of all kinds are listed on this page.", "/blog/1", "/pricing")),
    ("https://s.test/pricing", site_page("Pricing", "Every plan has its price and its features.", "/contact", "/page/2")),
    ("https://s.test/contact", site_page("Contact", "Write to us at any time of the day.", "/deep")),
    ("https://s.test/deep", site_page("Deep", "Nobody gets here at this depth of the crawl.")),
]


@query("SELECT * FROM " + values([
    (0, "https://s.test/", None, 0, 1000, "homepage", "success"), (1, "https://s.test/pricing", "https://s.test/", 1, 130, "important_path:pricing", "success"), (2, "https://s.test/about", "https://s.test/", 1, 120, "important_path:about", "http_error"),
    (3, "https://s.test/blog", "https://s.test/", 1, 55, "important_path:blog", "success"), (4, "https://s.test/contact", "https://s.test/pricing", 2, 80, "important_path:contact", "success"), (5, "https://s.test/blog/1", "https://s.test/blog", 2, 47, "important_path:blog", "http_error"),
], "visit_ord, url, source_url, depth, priority_score, priority_reason, status").replace("SELECT *", "SELECT CAST(visit_ord AS BIGINT) AS visit_ord, url, source_url, depth, priority_score, priority_reason, status"))
def crawl_visits(spark, sf_dir):
    snap = fetch.snapshot(spark.createDataFrame(SITE, "url string, html string"))
    return crawl.discover(spark, "s.test", snap).visits.select("visit_ord", "url", "source_url", "depth", "priority_score", "priority_reason", "status")


RESPONSES = [("a", 200, "text/html; charset=utf-8", "<p>x</p>"), ("b", 200, "application/pdf", "%PDF"), ("c", 404, "text/html", "no"), ("d", 200, None, "  <!DOCTYPE html><p>"), ("e", 200, None, "plain"), ("f", 200, "Application/XHTML+xml ", "<html/>"), ("g", 200, "", "<html>"), ("h", 301, "text/html", "")]


@query(f"""WITH r AS (SELECT *, CASE WHEN coalesce(ct, '') = '' THEN NULL ELSE lower(trim(split_part(ct, ';', 1))) END AS content_type FROM {values(RESPONSES, 'url, code, ct, body')}),
s AS (SELECT *, CASE WHEN code <> 200 THEN 'http_error' WHEN coalesce(content_type IN ('text/html', 'application/xhtml+xml'), regexp_matches(lower(ltrim(body)), '^(<!doctype html|<html)')) THEN 'success' ELSE 'non_html' END AS status FROM r)
SELECT url, status, status = 'success' AS ok, content_type, CASE WHEN status = 'success' THEN body END AS html FROM s""")
def fetch_classification(spark, sf_dir):
    df = spark.createDataFrame(RESPONSES, "url string, status_code int, content_type string, body string")
    return fetch.classify(df).select("url", "status", "ok", "content_type", "html")


CACHE_ROWS = [("k1", "u", "h", "j1", "2030-01-01T00:00:00+00:00", "2026-01-01T00:00:00"), ("k2", "u", "h", "j2", "2020-01-01T00:00:00+00:00", "2026-01-01T00:00:00"), ("k3", "u", "h", "j3", "never", "2026-01-01T00:00:00"), ("k4", "u", "h", "j9", "2030-01-01T00:00:00+00:00", "2026-01-01T00:00:00"), ("k1", "u", "h", "j2", "2029-06-01T00:00:00+00:00", "2026-02-01T00:00:00"), ("k5", "u", "h", "j1", "2028-01-01T00:00:00+00:00", "2026-01-01T00:00:00")]


@query(f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC) AS n FROM {values(CACHE_ROWS, 'cache_key, u, h, job_id, expires_at, created_at')})
SELECT cache_key, job_id FROM c WHERE n = 1 AND TRY_CAST(replace(expires_at, '+00:00', '') AS TIMESTAMP) > TIMESTAMP '2028-01-01 00:00:00' AND job_id IN ('j1', 'j2', 'j3')""")
def cache_valid(spark, sf_dir):
    entries = spark.createDataFrame(CACHE_ROWS, jobs.CACHE)
    results = spark.createDataFrame([(j, "{}", "2026-01-01") for j in ("j1", "j2", "j3")], jobs.RESULT)
    return jobs.valid_cache(entries, results, F.lit("2028-01-01 00:00:00").cast("timestamp")).select("cache_key", "job_id")


@query("""SELECT CAST(user_id AS VARCHAR) AS job_id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) FILTER (event_type <> 'view') AS progress,
arg_max(CASE WHEN event_type = 'error' THEN 'error' ELSE '-' END, event_id) AS error_message, min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY user_id""")
def job_latest_status(spark, sf_dir):
    """Events as a log: a user is a job, the type its status, the value a progress that views do not report."""
    e = table(spark, sf_dir, "events")
    none = F.lit(None).cast("string")
    log = e.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), none.alias("input_url"), none.alias("normalized_url"), F.col("event_type").alias("status"), F.when(F.col("event_type") != "view", F.col("value")).alias("progress"), none.alias("cache_key"), none.alias("request_config_json"), F.when(F.col("event_type") == "error", "error").otherwise("-").alias("error_message"), F.col("ts").alias("at"))
    return jobs.latest_jobs(log).select("job_id", "status", "progress", "error_message", "created_at", "updated_at")


@query("SELECT * FROM " + values([(4, 2, 4, 0, 0)], "pages_analyzed, pages_failed, chunks_analyzed, improvements_count, duplicate_findings_count").replace("SELECT *", "SELECT CAST(COLUMNS(*) AS BIGINT)"))
def audit_summary(spark, sf_dir):
    """The whole audit of the inline site, summed up."""
    snap = fetch.snapshot(spark.createDataFrame(SITE, "url string, html string"))
    pages, failed, _ = audit.extract_visits(crawl.discover(spark, "s.test", snap).visits)
    a = audit.audit_pages(pages)
    out = aggregate.summarize(a.results, failed=failed, chunks=a.chunks, findings=a.findings, signals=a.signals)
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("pages_analyzed", "pages_failed", "chunks_analyzed", "improvements_count", "duplicate_findings_count")])
