"""Operators that work text by text: against libraries and brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagegrain.llm import bpe, decontaminate, html_extract, license_scan, pieces, quality_crf, quality_rules, sharding, textscan, token_output, url_filter, workspace

SPEC = bpe.public_spec()
LIB = Tokenizer.from_str(SPEC)
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ids_of(text):
    return LIB.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'strevlmd  \n\t\r\xa01٣.,#é中\x1c\x85\u200b\U0001F600")) | st.characters(codec="utf-8"), max_size=30), max_size=5))
def test_pieces_and_both_encoders(texts):
    texts = [*texts, "a<|endoftext|>b", "don't we'll 're"]
    vocabulary = bpe.Vocabulary(SPEC)
    words = [b" we", b"don", b"'t", b" don"]
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words, vocabulary.merge))
    expected = [ids_of(t) for t in texts]
    for e in (bpe.encoder(vocabulary, lexicon), bpe.encoder(vocabulary, None), token_output.library_encoder(SPEC)):
        ids, offs = e.block(texts)
        assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == expected
    for x in expected:
        assert vocabulary.decode(np.array(x, np.int64)) == LIB.decode(x, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), max_size=40), st.lists(st.binary(max_size=7), max_size=20))
def test_lexicon_ranks(words, others):
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words, list))
    order = sorted(words)
    asked = order + others
    found = lexicon.find(asked)
    assert [r for r in found.tolist()] == [order.index(w) if w in words else -1 for w in asked]
    for w, r in zip(asked, found.tolist(), strict=True):
        if r >= 0:
            assert bytes(lexicon.ids[lexicon.upto[r]:lexicon.upto[r + 1]].tolist()) == w


def test_suffixes_are_shared():
    data = bpe.compile_lexicon([b"walking", b"talking", b"stalking"], list)
    assert np.frombuffer(data, np.uint32, 1)[0] < 12  # arcs; without sharing there are 22


def test_long_piece_merges_alike():
    v = bpe.Vocabulary(SPEC)
    word = "antidisestablishmentarianism" * 40
    assert v.merge(word.encode()) == ids_of(word)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.booleans(), st.sampled_from([7, 64, 1 << 16]))
def test_planes_round_trip(ids, bits, block):
    a = np.array(ids, np.uint32)
    payload = token_output.to_planes(a, bits=bits, block=block)
    assert (token_output.from_planes(payload) == a).all()
    assert (token_output.from_planes(payload, 1, 2) == a[block:2 * block]).all()


def test_colliding_words(spark):
    """Words on which polynomial hashes modulo 2^64 agree, and pieces too long to be kept."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    texts = [a, b, f"{a} {b}", "x" * 3000, b, a]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["ids_sha256"], r["decoded_sha256"]) for r in bpe.transcode(df, tokenizer=SPEC).collect()}
    assert got == {i: (hashlib.sha256(np.array(ids_of(t), "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
    path = token_output.write_tokens(df, token_output.workspace.new_path(spark, "t"), tokenizer=SPEC)
    assert {r["doc_id"]: r["ids"] for r in token_output.read_tokens(spark, path, with_ids=True).collect()} == {i: [*ids_of(t), 2] for i, t in rows}


def test_encoder_with_equal_hashes(monkeypatch):
    """If all pieces have one hash, their bytes still tell them apart."""
    monkeypatch.setattr(pieces.textscan, "run_hashes", lambda data, start, end, seed=0: (np.zeros(len(start), np.uint64),) * 2)
    for e in (bpe.encoder(bpe.Vocabulary(SPEC), None), token_output.library_encoder(SPEC)):
        for text in ("one two one three", "two one", "four"):
            assert e.block([text])[0].tolist() == ids_of(text)


def test_hot_ids_are_dealt(spark):
    rows = [(5, f"t{i % 7}") for i in range(300)] + [(None, f"n{i}") for i in range(200)] + [(i, "x y") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = token_output.write_tokens(df, token_output.workspace.new_path(spark, "t"), tokenizer=SPEC, rows_per_segment=20)
    assert max(r["n"] for r in spark.read.parquet(path).groupBy("segment").agg(token_output.F.sum("n_docs").alias("n")).collect()) < 80
    got = sorted((r["start"], r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"], tuple(r["ids"])) for r in token_output.read_tokens(spark, path, with_ids=True).collect())
    assert [d for _, _, d, _ in got] == sorted(-1 if d is None else d for d, _ in rows)
    assert all(a[0] + a[1] == b[0] for a, b in zip(got[:-1], got[1:], strict=True)) and got[0][0] == 0
    assert sorted((d, ids) for _, _, d, ids in got) == sorted((-1 if d is None else d, (*ids_of(t), 2)) for d, t in rows)


def test_neighbouring_segments_share_a_task(spark):
    """Many segments are written by few tasks, as files in document order, and read back whole."""
    rows = [(i, f"t{i % 7} " * (i % 5)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = token_output.write_tokens(df, token_output.workspace.new_path(spark, "t"), tokenizer=SPEC, rows_per_segment=10)
    held = [(r["f"].rsplit("/", 1)[1], r["segment"]) for r in spark.read.parquet(path).select("segment", token_output.F.input_file_name().alias("f")).collect()]
    assert len({s for _, s in held}) > 50
    assert len({f for f, _ in held}) <= token_output.tasks_of(60, 4) == 4
    assert [s for _, s in sorted(held)] == sorted(s for _, s in held)
    got = sorted((r["doc_id"], r["start"], tuple(r["ids"])) for r in token_output.read_tokens(spark, path, with_ids=True).collect())
    assert [(d, ids) for d, _, ids in got] == [(d, (*ids_of(t), 2)) for d, t in rows]
    assert [a for _, a, _ in got] == [sum(len(x) for _, _, x in got[:k]) for k in range(len(got))]
    assert [token_output.tasks_of(*x) for x in ((1, 200), (150, 200), (250, 51), (14648, 200))] == [1, 150, 51, 916]


def test_test_set_is_small():
    items = [(str(i), " ".join(f"w{(i * 7 + j) % 997}" for j in range(400))) for i in range(200)] + [("letters", "a b " * 3000)]
    tests = decontaminate.TestSet(items, 10)
    bits = len(tests.by_length) << decontaminate.BITS
    assert tests.nbytes() - bits <= decontaminate.WINDOW_BYTES * sum(len(t) + 1 for _, t in items)


def test_token_files(spark, edge, documents):
    for docs in (edge, documents.select("doc_id", "text"), edge.limit(0)):
        rows = docs.select("doc_id", "text").collect()
        path = token_output.write_tokens(docs, token_output.workspace.new_path(spark, "t"), tokenizer=SPEC, rows_per_segment=40, chunk_ids=2000)
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_output.read_tokens(spark, path).collect())
        enc = sorted((-1 if r["doc_id"] is None else r["doc_id"], zlib.crc32(a.tobytes()), len(a)) for r in rows for a in [np.array([*ids_of(r["text"] or ""), 2], "<u4")])
        start, expected = 0, []
        for d, crc, n in enc:
            expected.append((d, start, n, crc))
            start += n
        assert sorted(got) == sorted(expected)


def test_bpe_digests(edge, documents):
    for docs in (edge, documents):
        out = bpe.transcode(docs, tokenizer=SPEC)
        for r in out.collect():
            ids = ids_of(r["text"] or "")
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    full = bpe.transcode(edge, tokenizer=SPEC, lexicon=0, full=True).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in full)
    assert bpe.transcode(edge.limit(0), tokenizer=SPEC).count() == 0


def brute_hits(text, items, n=10):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    w, hit, found = split(text), set(), set()
    for item, t in items:
        b = split(t)
        k = min(n, len(b))
        wanted = {tuple(b[i:i + k]) for i in range(len(b) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i:i + k]) in wanted:
                hit |= set(range(i, i + k))
                found.add(item)
    return len(w), len(hit), sorted(found)


def test_decontamination(spark, edge):
    long = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = [("10", long), ("9", "one two three"), ("8", None), ("7", "  "), ("10", long), (None, "one")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = edge.select("doc_id", "text", "n_words").unionByName(spark.createDataFrame([(20, f"x ALPHA-{long[6:]} y. one, two? THREE!", "q"), (21, long[:30], "q")], "doc_id bigint, text string, n_words string"))
    known = [(i, t) for i, t in items if i]
    for size in (1 << 20, 1500):
        for r in decontaminate.scan_documents(docs, bench, broadcast_bytes=size).collect():
            assert (r["n_words"], r["n_hit"], r["item_ids"]) == brute_hits(r["text"], known), r
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove(docs, bench, action="spans").collect()}
    assert cut[20] == "x  y. !" and cut[21] == long[:30] and cut[5] == ""
    assert {r["doc_id"] for r in decontaminate.remove(docs, bench).collect()} & {5, 20} == set()
    assert decontaminate.scan_documents(docs, bench.limit(0)).where("contaminated").count() == 0


def brute_rules(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    hit = {p for v in seen.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_rule_statistics(edge, documents):
    for docs in (edge, documents):
        for r in quality_rules.with_statistics(docs.withColumnRenamed("text", "body"), "body").collect():
            base = brute_rules(r["body"])
            assert tuple(r[n] for n in quality_rules.BASE) == base
            assert r["base_failed"] == (base[0] < 20 or 100 * base[4] > 30 * base[0])


def test_rules_learn_and_keep_clean(spark, documents, labels):
    docs = documents.select("doc_id", "text")
    rules = quality_rules.learn(docs, labels)
    out = quality_rules.judge(docs, rules).join(labels, "doc_id").where("not base_failed")
    assert rules and out.where("quality = 1 and not kept").count() <= 1
    assert quality_rules.learn(docs, labels.limit(0)) == []
    assert [f for f in out.columns if f == "kept"] == ["kept"]


def test_no_python_in_rules(documents):
    plan = quality_rules.judge(documents.select("doc_id", "text"), [])._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_classifier(spark, edge, documents, labels):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_crf.learn(big, marks)
    held = quality_crf.classify(big, model).join(marks, "doc_id").where(quality_crf.is_held_out(quality_crf.F.col("doc_id"))).collect()
    right = sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in quality_crf.classify(edge, model).collect())
    none = quality_crf.learn(big, marks.limit(0))
    assert {r["score"] for r in quality_crf.classify(edge, none).collect()} == {none.score(np.zeros(1))[0]}


def test_long_texts_alike(monkeypatch):
    rng = np.random.default_rng(6)
    first = np.array([0, 3, 4, 90, 92])
    u, pair = rng.normal(size=92) * 3, rng.normal(size=(2, 2))
    expected = quality_crf.Chains(first).marginals(u, pair)[0]
    for limit in (0, 1, 50):
        monkeypatch.setattr(quality_crf, "LONG_CHAIN", limit)
        assert np.allclose(quality_crf.line_marginals(u, pair, first), expected)


def test_fit_is_bounded_in_lines(spark, monkeypatch):
    rows = [(i, "good words stand here\n" * 5 if i % 2 else "### $$$ !!! |||\n" * 5) for i in range(60)] + [(100, "\n" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    seen = []
    monkeypatch.setattr(quality_crf, "fit", lambda own, size, first, good: seen.append(len(own)) or quality_crf.Model(None, None, (0.0, 0.0)))
    quality_crf.learn(docs, labels)
    quality_crf.learn(docs, labels, fit_lines=100)
    assert 200 < seen[0] <= 360 and 0 < seen[1] <= 100


def test_forward_backward_by_enumeration():
    import itertools

    rng = np.random.default_rng(5)
    first = np.array([0, 3, 4, 8])
    u, pair = rng.normal(size=8), rng.normal(size=(2, 2))
    p, moves, log_z = quality_crf.Chains(first).marginals(u, pair)
    expected, total, pairs = np.zeros(8), 0.0, np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:], strict=True):
        weights = {}
        for y in itertools.product((0, 1), repeat=b - a):
            weights[y] = np.exp(sum(u[a + i] * s for i, s in enumerate(y)) + sum(pair[s, t] for s, t in itertools.pairwise(y)))
        z = sum(weights.values())
        total += np.log(z)
        for y, w in weights.items():
            for i, s in enumerate(y):
                expected[a + i] += s * w / z
            for s, t in itertools.pairwise(y):
                pairs[s, t] += w / z
    assert np.allclose(p, expected) and np.isclose(total, log_z) and np.allclose(moves, pairs)


def test_licenses(spark, edge):
    mit = license_scan.KNOWN["MIT"][1]
    rows = [(1, f"Copyright (c) 2020 Somebody\n{mit.upper()}"), (2, "text\n released under the MIT licence!\nmore"), (3, mit[:-5]), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r["doc_id"]: (r["license"], r["line_licenses"]) for r in license_scan.scan(df).collect()}
    assert got == {1: ("MIT", []), 2: (None, ["MIT"]), 3: (None, []), 4: (None, []), 5: (None, [])}
    assert license_scan.scan(edge).count() == edge.count()


def test_shards(spark, edge, documents):
    for docs in (edge, documents.select("doc_id", "text"), documents.select("doc_id", "text").limit(0)):
        rows = sharding.assign(docs).collect()
        assert len(rows) == docs.count()
        sizes, slots = {}, {}
        for r in rows:
            sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(8))
        if sizes:
            largest = max(r["size"] for r in rows)
            assert max(sizes.values()) <= sum(sizes.values()) / 8 + largest
        expected = sorted((len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
        assert sorted((r["size"], r["text_crc32"]) for r in rows) == expected


def test_shards_by_sql(spark, edge, documents):
    """The whole assignment by DuckDB, from the order and the law alone."""
    import duckdb

    sql = """
    WITH o AS (
      SELECT *, sum(size) OVER (ORDER BY k, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total, row_number() OVER (ORDER BY k, doc_id NULLS FIRST) AS place
      FROM (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, substr(md5(coalesce(text, '')), 1, 15) AS k FROM d)),
    s AS (SELECT *, least(7, ((2 * upto - size) * 8) // (2 * total)) AS shard FROM o)
    SELECT coalesce(doc_id, -1), size, shard, place - min(place) OVER (PARTITION BY shard) AS slot FROM s ORDER BY ALL"""
    for docs in (edge.select("doc_id", "text"), documents.select("doc_id", "text"), documents.select("doc_id", "text").repartition(7)):
        d = docs.toPandas()  # noqa: F841
        expected = [tuple(map(int, r)) for r in duckdb.sql(sql).fetchall()]
        got = sharding.assign(docs).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["shard"], r["slot"]) for r in got) == expected


def test_written_shards(spark, edge):
    docs = edge.unionByName(edge.where("doc_id = 7")).unionByName(edge.where("doc_id is null")).withColumnRenamed("shard", "SLOT")
    path = token_output.workspace.new_path(spark, "shards")
    sharding.write_shards(docs, path)
    got = spark.read.parquet(path)
    key = lambda r: (r["doc_id"] or -1, r["text"] or "")
    assert sorted(map(key, got.collect())) == sorted(map(key, docs.collect()))
    expected = sharding.assign(docs).select("doc_id", "shard", "slot").collect()
    assert sorted(map(str, expected)) == sorted(map(str, got.select("doc_id", "shard", "slot").collect()))


def test_shards_split_a_hot_group(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'the same text for a third of all rows' else concat('text number ', id) end as text")
    sizes = [r["b"] for r in sharding.assign(df).groupBy("shard").agg(sharding.F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 100


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<script>x</script>", ""), ("plain &amp; simple", "plain & simple"),
    ("<nav>Menu</nav><article><h1>T</h1><p>a&nbsp;b <b>c</b>d<p>e<br>f</article><footer>x</footer>", "T a b cd e f"),
    ("<article><p>x</p><section class='comments'><article><p>no</p></article></section><p>y</p></article>", "x y"),
    ("<div class=ad>never closed <article><p>body</p></article>", "body"), ("<article><p>cut <b", "cut"), ("<main><form>f</form><p>1 < 2</p></main><p>after</p>", "1 < 2"),
])
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


def test_main_text_without_main_element():
    body = "Long sentences of the article stand here and go on for a while. " * 4
    page = f"<header>Site</header><ul class=menu><li>a</li></ul><div><h2>Head</h2><p>{body}</p><p>Short.</p></div><div class='sidebar'>s</div><div class=footer>f</div>"
    assert html_extract.main_text(page) == f"Head {body.strip()} Short."


def test_pages_table(spark, sf):
    import html as h

    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in html_extract.query(spark, sf).collect()}
    for r in pages:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        blocks = (" ".join(h.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"<(?:/?p|/?h1|br)>", inner))
        assert got[r["page_id"]] == " ".join(b for b in blocks if b)


def test_urls(spark):
    rows = [(1, "https://a.example.org/es/x"), (2, "http://example.org/en/12"), (3, "http://x.org/y"), (4, "http://Sub.COM/fr/1"), (5, "https://s.com/de/1?x"), (6, "http://a.net/casino/x"), (7, "http://a.net/casinox"), (8, "http://a.net/cheap-pills"), (9, "http://a.net/cheap-cheap"), (14, "http://a.net/free-click"), (15, "http://a.net/free-click-win"), (16, "http://a.net/pills-pills"), (10, None), (11, "nothing"), (12, "http://org"), (13, "x://b.net#casino")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id int, url string")).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: ("org/", "allow"), 4: ("com/fr/", "allow"), 5: ("com/de/", "block"), 6: (None, "block"), 7: (None, "allow"), 8: (None, "block"), 9: (None, "allow"), 14: (None, "allow"), 15: (None, "block"), 16: (None, "allow"), 10: (None, "allow"), 11: (None, "allow"), 12: (None, "allow"), 13: (None, "block")}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té1-", max_size=20), max_size=6))
def test_words_of_a_block(texts):
    import pyarrow as pa

    for mask, pattern in ((textscan.NON_SPACE, r"[^\x20\x09-\x0D]+"), (textscan.ALNUM, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
        for a, b, w in textscan.scan(pa.array(texts, pa.string()), mask):
            for d in range(a, b):
                own = [w.text(i).decode("utf-8", "replace").translate(LOW) for i in range(w.first[d - a], w.first[d - a + 1])]
                assert own == re.findall(pattern, texts[d].translate(LOW))
    assert pieces.classes()[ord(" ")] == pieces.SPACE


LONG = "Long sentences of the article stand here and go on for a while. " * 4


@pytest.mark.parametrize("page,text", [
    ("<article><p>a</p><section id=discussion><h2 id=related-work>b</h2><p>c</p></section><h2 class=cookies>d</h2><div class=social-history>e</div></article>", "a b c d e"),
    ("<article><p>a</p><div class='box share'>s</div><p>b</p></article>", "a b"),
    (f"<div class=content-sidebar-wrap><p>{LONG}</p></div>", LONG.strip()),
    (f"<div class=search><div id=related><div class=social><p>{LONG}</p></div></div></div>", LONG.strip()),
    (f"<div class=site-footer>f</div><div class=has-sidebar><p>{LONG}</p></div><div id=left-sidebar>s</div>", LONG.strip()),
    ("<article><p class=ad>x<p>real<p>more</article>", "real more"),
    ("<article><ul><li class=share>x<li>y<li class=share>z</ul><p>real</p></article>", "y real"),
    ("<article><div><span class=ad>x</div><p>real</p></article>", "real"),
    ("<article><ul><li class=share>x<ul><li>y</ul>z<li>real</ul></article>", "real"),
    ("<article><p>a <svg viewBox='0 0 1 1'/> b</p><p><math/>c<svg><text>no</text></svg></p></article>", "a b c"),
])
def test_noise_of_main_text(page, text):
    assert html_extract.main_text(page) == text


def test_gaps_end_a_surge():
    side = "<div class=sidebar><p>a</p><p>b</p><p>c</p></div>"
    body = LONG.strip()
    assert html_extract.main_text(f"<div><p>Intro.</p><p>{LONG}</p><p>End.</p></div>{side}<div>Imprint</div>") == f"Intro. {body} End."
    assert html_extract.main_text(f"<div><p>{LONG}</p></div>{side}<div><p>{LONG}</p></div>") == f"{body} {body}"
    assert html_extract.main_text(f"<div><p>{LONG}</p><div class=ad>x</div><p>End.</p></div>") == f"{body} End."
    assert html_extract.main_text(f"<article><p>{LONG}</p>{side}<p>End.</p></article>") == f"{body} End."


def brute_blocks(size, window, threshold):
    """Line-block distribution, line by line: a text starts where a block reaches the threshold, and lasts until a block is empty."""
    keep, on = [False] * len(size), False
    for i in range(len(size)):
        block = sum(size[i:i + window])
        if not on and size[i] and block >= threshold:
            on, j = True, i
            while j > 0 and size[j - 1]:
                j -= 1
                keep[j] = True
        on = on and block > 0
        keep[i] = keep[i] or on
    return keep


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 1, 5, 40, 90]), max_size=25), st.integers(1, 4), st.sampled_from([1, 50, 86]))
def test_surges_by_brute_force(size, window, threshold):
    keep = [False] * len(size)
    for a, b in html_extract.surges(size, window, threshold):
        keep[a:b] = [True] * (b - a)
    want = brute_blocks(size, window, threshold)
    assert [k for k, s in zip(keep, size, strict=True) if s] == [k for k, s in zip(want, size, strict=True) if s]


def test_main_element_is_a_prior():
    card = "<article class=card><h3>Teaser</h3><p>Read this too.</p></article>"
    assert LONG.strip() in html_extract.main_text(f"<div><p>{LONG}</p></div>{card}")
    assert html_extract.main_text(f"<div>{LONG[:90]}</div><article><h1>T</h1><p>{LONG}</p><p>End.</p></article><div>after</div>") == f"T {LONG.strip()} End."
    poem = "".join(f"<p>line {i}</p>" for i in range(12))
    assert html_extract.main_text(f"<p>{LONG[:100]}</p><article>{poem}</article>") == " ".join(f"line {i}" for i in range(12))


def test_advert_hosts(spark):
    rows = [(1, "https://m.ads-track.example.net/x"), (2, "https://adserver.site.net/a"), (3, "https://ads.site.net/tracking/1"), (4, "https://track.site.net/parcel"), (5, "https://ads.site.net/contact"), (6, "https://downloads.site.net/soundtrack"), (7, "https://click.site.net/banner?x"), (8, None)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id int, url string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow"}


def test_licenses_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "MAX_BROADCAST_ROWS", 3)
    known = {f"n{i}": [f"known text {i}"] for i in range(50)} | {"twice": ["a license license"]}
    rows = [(1, "a licence licence"), (2, "known text 7\nother\nKnown: text 8!\nknown text 7"), (2, "nothing"), (3, None)]
    got = [(r["doc_id"], r["license"], r["n_license_lines"], r["line_licenses"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id int, text string"), known).collect()]
    assert sorted(got, key=str) == sorted([(1, "twice", 1, ["twice"]), (2, None, 3, ["n7", "n8"]), (2, None, 0, []), (3, None, 0, [])], key=str)


def test_entire_licenses(spark):
    texts, bsd = license_scan.license_texts.TEXTS, license_scan.license_texts.TEXTS["BSD-3-Clause"]
    isc = license_scan.KNOWN["ISC"][0]
    two = bsd[:bsd.index("3. Neither")] + bsd[bsd.index("THIS SOFTWARE IS"):]
    mit = "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + license_scan.KNOWN["MIT"][1]
    rows = [(k.split(" ")[0], t.upper()) for k, t in texts.items()] + [("MIT", mit), ("ISC", f"ISC License\n\nCopyright (c) 2020 A\n\n{isc}")]
    rows += [("BSD-2-Clause", f"BSD 2-Clause License\n\nCopyright (c) 2020, A\nAll rights reserved.\n\n{two}"), ("Apache-2.0", texts["Apache-2.0"].split("APPENDIX")[0]), (None, texts["GPL-3.0"][:-200])]
    got = license_scan.scan(spark.createDataFrame(rows, "expected string, text string")).select("expected", "license").collect()
    assert [r["license"] for r in got] == [r["expected"] for r in got] and len(got) == len(rows)


def test_arrow_tasks_leave_little_memory(spark):
    """A batch of long texts is bounded by bytes; a worker's lexicon goes when another operator's task begins."""
    import pyarrow as pa

    docs = spark.range(0, 40, 1, 1).selectExpr("id", "repeat('x', 1000000) AS text")
    texts = workspace.in_arrow(docs, lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([x.nbytes])], names=["n", "size"]) for x in batches), "n long, size long").collect()
    assert sum(r["n"] for r in texts) == 40 and max(r["size"] for r in texts) <= workspace.BATCH_BYTES + 1_100_000
    spec, held = SPEC, bpe.compile_lexicon([], bpe.Vocabulary(SPEC).merge)
    bpe.worker_encoder(spec, held)
    workspace.begin("bpe")
    assert bpe._WORKER
    workspace.begin("decontaminate")
    assert not bpe._WORKER
