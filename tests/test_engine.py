"""Operators on small rows: boundaries, ties, nulls, order."""

import json

import pytest
from pyspark.sql import functions as F

from pagegrain.functions import text as tx
from pagegrain.functions import urls
from pagegrain.operators import aggregate, audit, chunk, crawl, extract, links, model_output, prompts, signals, similarity
from pagegrain.plans import audit_queries as aq
from pagegrain.sources import fetch, jobs, report


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_text_functions(spark):
    rows = [(0, " a 　b\x1cc "), (1, "x" * 10), (2, ""), (3, None), (4, "One. Two!  Three? four"), (5, "p1\n\np2\nq"), (6, "l1\nl2")]
    got = {r[0]: r[1:] for r in values(spark, rows, "i int, t string", "i", tx.normalize_whitespace(F.col("t")), tx.token_estimate(F.col("t")), tx.text_blocks(F.col("t")))}
    assert got[0][0] == "a b c" and got[1][1] == 2 and got[2][1] == 0 and got[2][2] == []
    assert got[4][2] == ["One.", "Two!", "Three?", "four"] and got[5][2] == ["p1", "p2 q"] and got[6][2] == ["l1", "l2"]
    assert tuple(got[3]) == (None, 0, None)


def test_canonical(spark):
    more = [("HTTP://u:p@H.com:80//a//b%20c/?b=2&utm_x=1&a=1&b=&a=0#f", None, "http://h.com/a/b%20c?a=0&a=1&b=&b=2", None), ("https://h.com:8443/%7Ex/é", None, "https://h.com:8443/~x/%C3%A9", None), ("x/%2F", "https://h.com/y/", "https://h.com/y/x", None), ("https://h.com/?q=a+b~*&Q=1", None, "https://h.com/?Q=1&q=a+b~%2A", None), ("https://h.com:99999/", None, None, urls.BAD_PORT)]
    cases = [tuple(r[1:]) for r in aq.URL_CASES] + more
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, url string, base string, expected string, error string")
    got = df.select("i", urls.canonical_url(F.col("url"), F.col("base")).alias("c")).orderBy("i").collect()
    assert [(r["c"]["url"], r["c"]["error"]) for r in got] == [c[2:] for c in cases]
    assert urls.canonical_one(spark, " h.com/x/ ") == ("https://h.com/x", None)
    assert df.select(urls.canonical_url(F.lit("h.com/?utm_a=1&b=2"), keep_tracking=True, default_scheme="http")["url"]).first()[0] == "http://h.com/?b=2&utm_a=1"
    assert df.limit(1).select(urls.canonical_equal(F.lit("H.com/x/?utm_b=1"), F.lit("https://h.com/x")), urls.canonical_equal(F.lit("h.com/y"), F.lit("h.com/x")), urls.canonical_equal(F.lit(""), F.lit(""))).first() == (True, False, False)


def test_same_domain(spark):
    rows = [("https://www.a.com/x", "http://a.com:8080/"), ("https://b.a.com/", "https://a.com/"), ("https://a.org/", "https://a.com/")]
    got = values(spark, rows, "u string, v string", urls.same_domain(F.col("u"), F.col("v")), urls.same_domain(F.col("u"), F.col("v"), subdomains=True))
    assert got == [(True, True), (False, True), (False, False)]


def test_link_reasons(spark):
    hrefs = ["", None, "#x", "mailto:a@b", "http://[::1", "https://o.com/a.pdf", "/a.pdf", "/login", "/x?page=2", "/x?page=1", "/p-3", "/x?a=1&b=2&c=3&d=4&e=5", "/x?share=1", "/seen", "/login?q=1", "/ok#f"]
    df = spark.createDataFrame([(i, h, "https://s.com/", "https://s.com/") for i, h in enumerate(hrefs)], "i int, href string, base_url string, site_root string")
    seen = spark.createDataFrame([("https://s.com/seen",)], "url string")
    got = [r["reason"] for r in links.filter_links(df, seen=seen).orderBy("i").collect()]
    assert got == ["empty_link", "empty_link", "fragment_only", "blocked_scheme", "invalid_url", "external_domain", "non_html_asset", "low_value_path", "low_value_path", "accepted", "low_value_path", "low_value_path", "low_value_path", "duplicate_url", "low_value_path", "accepted"]


def test_priority(spark):
    rows = [("https://s.com/",), ("https://s.com/pricing",), ("https://s.com/services/a?x=1",), ("https://s.com/docs/documentation",), ("https://s.com/a/b/c/d",)]
    s, r = links.priority(F.col("u"), F.lit("https://s.com/"))
    assert values(spark, rows, "u string", s, r) == [(1000, "homepage"), (130, "important_path:pricing"), (97, "important_path:service"), (92, "important_path:docs"), (0, "standard_page")]


def test_crawl_depth_zero_means_default_and_bad_start(spark):
    snap = fetch.snapshot(spark.createDataFrame(aq.SITE, "url string, html string"))
    c = crawl.discover(spark, "https://s.test/blog", snap, max_depth=0, max_pages=3)
    assert [(r["url"], r["priority_score"]) for r in c.visits.orderBy("visit_ord").collect()] == [("https://s.test/blog", 1001), ("https://s.test/", 1000), ("https://s.test/pricing", 130)]
    bad = crawl.discover(spark, "mailto:x", snap)
    assert bad.visits.count() == 0 and bad.warnings.first()["code"] == "invalid_start_url"


def test_extraction_rules(spark):
    page = """<html><head><title> T </title><script>var x = "</p>";</script></head><body><header class="site-header"><nav>n</nav></header>
    <div class="cookie-banner"><p>We use cookies here, accept them all</p></div><main><p>Before any heading there is text</p><h1>Top</h1><h2>Sub</h2>
    <p>A paragraph&nbsp;of <b>bold</b>text here <p>unclosed goes on</p><button>Get started now</button><button>OK</button><a class="btn" href="x">Read</a>
    <aside class="sidebar"><p>Related things to look at</p></aside><table><tr><td>Cell text is long enough</td></tr></table></main></body></html>"""
    e = extract.extract_pages(spark.createDataFrame([("https://s.com/", page)], "url string, html string")).first()
    assert e["title"] is None and e["h1"] == "Top"
    assert [s["heading_path"] for s in e["sections"]] == [["Page Content"], ["Top", "Sub"]]
    assert e["sections"][0]["text"] == "Before any heading there is text"
    assert e["sections"][1]["text"].startswith("A paragraph of bold text here unclosed goes on")
    assert "Cell text" in e["sections"][1]["text"] and "Related" not in e["sections"][1]["text"]


def test_extract_failed_and_empty(spark):
    rows = [("u1", None, False, "http_error", "Unexpected HTTP status 404."), ("u2", "<p>x</p>", True, "success", None)]
    df = spark.createDataFrame(rows, "url string, html string, ok boolean, status string, error string")
    got = {r["url"]: [w["code"] for w in r["warnings"]] for r in extract.extract_pages(df, ok="ok", status="status", error="error").collect()}
    assert got == {"u1": ["http_error"], "u2": ["missing_title", "missing_h1", "no_meaningful_headings", "low_text"]}


def test_chunk_packing(spark):
    text = "Aaa bbb. Ccc ddd. " + "w" * 30 + ". Eee."
    got = spark.createDataFrame([(text,)], "t string").select(chunk.pack(tx.sentences(F.col("t")), max_chars=20, target_chars=17)).first()[0]
    assert got == ["Aaa bbb. Ccc ddd.", "w" * 30 + ".", "Eee."]


def test_signal_boundaries(spark):
    sec = "array<struct<section_id:string,heading_path:array<string>,heading_level:int,heading_text:string,text:string,order:int,source_selector:string>>"
    mk = lambda *texts: [(f"s{i}", ["H"], 2, "Heading", t, i, None) for i, t in enumerate(texts)]
    rows = [("https://e.com/x", "T", "H", 299, mk("a" * 119, "b" * 120)), ("https://e.com/y", None, None, 300, mk("c " * 1101)), ("https://e.com/z", "", "", 0, None)]
    df = spark.createDataFrame(rows, f"url string, title string, h1 string, text_char_count int, sections {sec}")
    got = {}
    for r in signals.page_signals(df).collect():
        got.setdefault(r["page_url"][-1], []).append(r["signal_type"])
    assert sorted(got["x"]) == ["repeated_heading", "thin_page", "thin_section"]
    assert sorted(got["y"]) == ["dense_section", "long_paragraph", "weak_structure"]
    assert sorted(got["z"]) == ["thin_page", "weak_structure"]


def test_similarity_ties_and_zero_vectors(spark):
    rows = [("a", "p", 0, [1.0, 0.0]), ("b", "q", 1, [1.0, 0.0]), ("c", "q", 2, [2.0, 0.0]), ("d", "q", 3, [0.0, 0.0]), ("e", "q", 4, [1.0]), ("f", "p", 5, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, page string, ord int, vector array<double>")
    got = [(r["match_id"], r["score"]) for r in similarity.similar(df.where("id = 'a'"), df, top_k=2, cross_page_only=True, block_rows=2).orderBy("rank").collect()]
    assert got == [("b", 1.0), ("c", 1.0)]
    assert similarity.similar(df, df, top_k=0).count() == 0


def test_json_candidates():
    assert model_output.json_candidate('x {"a": "}"} y') == '{"a": "}"}'
    assert model_output.json_candidate("[note] {}") == "[note]"
    assert model_output.json_candidate("{]") is None and model_output.json_candidate("none") is None
    assert model_output.read_answer('{"improvements": null}')["error"]
    got = model_output.read_answer('{"improvements": [{"issue": "i", "suggested_change": "s", "reason": "r", "confidence": NaN, "evidence_snippet": "e"}]}')
    assert got["improvements"][0]["confidence"] == 0.0


def test_exact_rounding():
    assert str(aggregate.exact_decimal(2.675, 2)) == "2.67" and str(aggregate.exact_decimal(0.125, 2)) == "0.12" and str(aggregate.exact_decimal(0.15, 1)) == "0.1"


def test_prompt_context(spark):
    chunks = spark.createDataFrame([("c1", "https://e.com/pricing", "T", "H", "s0", ["H"], "H", 1, "Text of it", 0, 3)], "chunk_id string, page_url string, page_title string, page_h1 string, section_id string, section_path array<string>, section_heading string, section_heading_level int, chunk_text string, chunk_order int, token_estimate int")
    sig = spark.createDataFrame([("https://e.com/pricing", i, f"k{i}", "s0" if i else "other", None, "low", 0.5, "m", None, "{}") for i in range(9)], "page_url string, signal_ord int, signal_type string, section_id string, chunk_id string, severity string, confidence double, message string, evidence_snippet string, metadata string")
    near = spark.createDataFrame([], "query_id string, match_id string, score double, cross_page boolean, rank int")
    dup = spark.createDataFrame([], "finding_type string, source_chunk_id string, matched_chunk_id string, matched_page_url string, similarity_score double, message string, evidence_snippet string, matched_evidence_snippet string, left_ord long, right_ord long")
    row = prompts.build_prompts(chunks, sig, near, dup).first()
    context = json.loads(row["context"])
    assert row["page_type"] == "pricing" and [s["signal_type"] for s in context["heuristic_signals"]] == [f"k{i}" for i in range(1, 7)]
    assert row["context"] in row["prompt"]


def test_job_life(spark, tmp_path):
    store = jobs.Store(spark, f"file://{tmp_path}/store")
    job, hit = audit.submit(store, "s.test", include_html_report=True)
    assert not hit and audit.answer(store, job)[0] == 202 and audit.answer(store, "nope")[0] == 404
    snap = fetch.snapshot(spark.createDataFrame(aq.SITE, "url string, html string"))
    result = audit.run_job(store, job, snap, reports=str(tmp_path / "reports"))
    assert result["status"] == "partial" and result["summary"]["pages_analyzed"] == 4
    assert audit.answer(store, job)[0] == 200 and audit.submit(store, "https://s.test/", include_html_report=True) == (job, True)
    assert audit.submit(store, "s.test", include_html_report=True, force_refresh=True)[1] is False
    assert report.resolve(tmp_path / "reports", result["html_report_path"], job) and report.resolve(tmp_path / "reports", "/etc/passwd", "x") is None


def test_report_escapes():
    page = report.render({"job_id": "<j>", "pages": [{"title": "<b>&\"", "improvements": [{"issue": "<i>", "severity": "high", "suggested_change": "c"}]}]})
    assert "<j>" not in page and "<i>" not in page and "&lt;b&gt;&amp;&quot;" in page and jobs.safe_name("../x/..") == "x.html"


def test_streaming_facts(spark, tmp_path):
    from pagegrain.streaming import ingest

    spark.createDataFrame([(1, "HTTPS://A.com/x/", "<p>"), (2, None, None)], ingest.PAGES).write.parquet(str(tmp_path / "in"))
    ingest.write_facts(ingest.read_pages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, "https://a.com/x", "a.com", 1, 3), (2, None, None, None, 0)]


def test_findings_are_capped_per_site(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron sigma upsilon omega psi chi " * 4
    rows = [(f"{s}{i}", f"https://{s}.test/{i}", "s", words, len(words), k * 10 + i, [1.0, 0.0]) for k, s in enumerate("ab") for i in range(3)]
    df = spark.createDataFrame(rows, "chunk_id string, page_url string, section_id string, chunk_text string, text_length int, ord long, vector array<double>")
    got = similarity.duplicate_findings(df.drop("vector"), df.select("chunk_id", "vector"), max_findings=2, per_site=True, min_words=5, block_rows=2).collect()
    assert sorted((r["source_chunk_id"], r["matched_chunk_id"]) for r in got) == [("a0", "a1"), ("a0", "a2"), ("b0", "b1"), ("b0", "b2")]
    assert similarity.duplicate_findings(df.drop("vector"), df.select("chunk_id", "vector"), max_findings=2, min_words=5, block_rows=2).count() == 2
