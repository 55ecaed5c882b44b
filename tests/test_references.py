"""Character references: the operator decodes all, a query those that its SQL decodes."""

import duckdb

from pagegrain import plans
from pagegrain.operators import extract


def agrees(spark, folder, name, pages):
    """Rows of the query, which are those of its SQL."""
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    rel = con.execute(plans.ORACLES[name])
    names = sorted(d[0] for d in rel.description)
    expected = sorted(repr([r[[d[0] for d in rel.description].index(c)] for c in names]) for r in rel.fetchall())
    found = plans.QUERIES[name](spark, str(folder)).collect()
    assert sorted(repr([r[c] for c in names]) for r in found) == expected
    return found


def page(title, body, footer=""):
    return f"<html><head><title>{title}</title></head><body><article><h1>{title}</h1><p>{body}</article><footer>{footer}</footer></body></html>"


def test_body_length_of_the_warnings(spark, tmp_path):
    html = [page("Some title", "A short text of the page", f"&copy; 2024 &middot; {'x' * n}") for n in (242, 243, 300)] + [page("Tom &amp Co", "R&amp;D&nbsp;is &lt;b&gt; &#39;x&#39; &eacute; &quot;q&quot;", "y" * 200)]
    found = agrees(spark, tmp_path, "extraction_warnings", [(i, f"https://s.test/{i}", h) for i, h in enumerate(html)])
    assert sorted(r["page_id"] for r in found if r["code"] == "mostly_boilerplate") == [1, 2]


def test_sections_and_their_headings(spark, tmp_path):
    html = [page("Its token = &quot", "A body of &quot;some&quot; words &copy; 2024"), page("Tom &amp Co &amp; Sons", "Caf&eacute; or caf&#233; &lt;i&gt; and &amp;lt; all of it"), page("&lt;b&gt;&nbsp;of &#39;it&#39;", "A&nbsp;b &ampere &gt it is")]
    found = agrees(spark, tmp_path, "page_sections", [(i, f"https://s.test/{i}", h) for i, h in enumerate(html)])
    assert {r["page_id"]: r["h1"] for r in found} == {0: "Its token = &quot", 1: "Tom & Co & Sons", 2: "<b> of 'it'"}


def test_titles(spark, tmp_path):
    titles = ["Cut*** off&amp;&amp;&amp", "Tom &amp; &quot;Co&quot; &lt;i> &amp;lt; &gt; &copy; &#39;", "a &quot b &nbsp; &AMP; c & d"]
    found = agrees(spark, tmp_path, "page_title", [(i, f"https://s.test/{i}", page(t, "Some words of a body")) for i, t in enumerate(titles)])
    assert {r["page_id"]: r["title"] for r in found} == {0: "Cut*** off&&&amp", 1: 'Tom & "Co" <i> &lt; &gt; &copy; &#39;', 2: "a &quot b &nbsp; &AMP; c & d"}


def test_operator_decodes_all_references(spark):
    html = page("Tom &amp Co &copy", "Caf&eacute; &middot; &#169; all of it")
    row = extract.extract_pages(spark.createDataFrame([("u", html)], "url string, html string")).first()
    assert row["title"] == "Tom & Co ©" and row["sections"][0]["text"] == "Café · © all of it"
