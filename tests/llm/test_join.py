"""The n-gram join, the pipeline and the registered queries."""

import re
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pagegrain.llm import ngram_join, quality_crf, quality_rules, registry, workspace

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    index = {}
    for i, s in enumerate(sets):
        count = Counter(j for g in s for j in index.get(g, ()))
        for j, both in count.items():
            if den * both >= num * (len(s) + len(sets[j]) - both):
                up[find(i)] = find(j)
        for g in s:
            index.setdefault(g, []).append(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return Counter((d, len(s), low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def family(n, words, edits, seed):
    """Near copies of one text, each with a few words of its own."""
    import random

    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(words)] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80), (3, 50), (4, 100)])
def test_join_against_brute_force(spark, k, num):
    texts = [None, "", " ", "one", "ONE", "one two three", "a b c d", "a b c d"]
    passage = " ".join(f"p{i}" for i in range(30))
    for i, (n, words, edits) in enumerate(((25, 60, 3), (12, 300, 12), (6, 2000, 60), (5, 5000, 150), (4, 9000, 200), (30, 12, 1))):
        texts += family(n, words, edits, i)
    texts += [f"{passage} " + " ".join(f"u{i}_{j}" for j in range(20 + i)) for i in range(60)]
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter(map(tuple, ngram_join.join_components(df, k=k, num=num).collect()))
    assert got == brute(rows, k, num, 100)


def test_join_splits_large_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 500)
    rows = [(i, t) for i, t in enumerate(family(40, 50, 3, 1) + family(20, 80, 4, 2))]
    got = Counter(map(tuple, ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows, 4, 85, 100)


def test_join_edge_rows(edge, spark):
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(edge).collect()}
    assert rows[1] == (0, 1) and rows[4] == (1, 4) and rows[6] == (rows[7][0], 6) and rows[7][1] == 6
    assert ngram_join.join_components(edge).count() == edge.count() and ngram_join.join_components(edge.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ngram_join.join_components(edge, num=30)


def doubled():
    """Two different words of 1,024 letters on which any polynomial hash modulo 2^64 of an odd base agrees."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    return a, b


def test_join_tells_colliding_words_apart(spark):
    a, b = doubled()
    base = [f"w{i}" for i in range(30)]
    rows = [(1, a), (2, b), (3, b), (4, " ".join([*base, a])), (5, " ".join([a, *base])), (6, " ".join([*base[:15], a, *base[15:]])), (7, " ".join([*base[:15], b, *base[15:]]))]
    got = Counter(map(tuple, ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows, 4, 85, 100)


def test_maps_travel_few_times(spark):
    """Bitmaps of near copies meet in few groups, however many n-grams their prefixes share."""
    rows = [(i, t) for i, t in enumerate(family(2, 20000, 300, 5) + family(12, 3000, 60, 6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = workspace.written(ngram_join.class_rows(docs, 4, 85, 100, ngram_join.np.zeros(1, "u8"), 0), "test")
    per = Counter(r["node"] for r in ngram_join.tile_groups(ngram_join.classes_of(sets), 85, 100).collect())
    assert max(per.values()) <= 24
    assert Counter(map(tuple, ngram_join.join_components(docs).collect())) == brute(rows, 4, 85, 100)


def test_one_of_each(spark):
    w = [f"w{i}" for i in range(100)]
    near, other = " ".join(w), "quite another text of more than five words"
    rows = [(5, near, "a"), (5, other, "b"), (3, " ".join([*w[:-1], "x"]), "c"), (3, " ".join([*w[:-1], "x"]), "d"), (None, near, "e"), (None, None, "f"), (7, other, "g"), (8, "", "h"), (None, "alone here but long enough indeed", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    got = [tuple(r) for r in ngram_join.one_of_each(df, k=5, num=80).collect()]
    assert sorted(r[2] for r in got if r[0] != 3) == ["b", "f", "h", "i"] and [r[:2] for r in got if r[0] == 3] == [rows[2][:2]]
    assert ngram_join.one_of_each(df.limit(0)).count() == 0


def test_one_of_each_beyond_the_broadcast(spark, monkeypatch):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, a), (1, b), (2, a + " end"), (None, a), (None, b), (3, None), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted([(1, a), (1, b), (3, None), (3, None), (4, "")], key=repr)
    for limit in (ngram_join.BROADCAST_DROPS, 0):
        monkeypatch.setattr(ngram_join, "BROADCAST_DROPS", limit)
        assert sorted((tuple(r) for r in ngram_join.one_of_each(df, k=5, num=80).collect()), key=repr) == expected


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (200, 200)] + [(300, i) for i in range(301, 330)]
    got = dict(map(tuple, ngram_join.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()))
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100} | {i: 300 for i in range(300, 330)}


def plain_score(text, model):
    """The classifier in plain Python: features of each line, sums over all good/bad sequences by recursion, length-weighted share."""
    import math

    own, sizes = [], []
    for line in (text or "").split("\n"):
        raw = line.encode()
        count = lambda chars, raw=raw: sum(b in chars.encode() for b in raw)
        words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        low = [w.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for w in words]
        one, per = max(len(words), 1), max(len(raw), 1)
        upper, lower = count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count("abcdefghijklmnopqrstuvwxyz")
        own.append([
            min(count("#*$%&<>~^@=+_\\") / one, 3), min(count("|") / one, 1), min(count("!?") / one, 3), upper / max(upper + lower, 1),
            sum(x == y for x, y in zip(low[:-1], low[1:], strict=True)) / one, count("0123456789") / per, min(count(".,;:") / one, 2),
            min((len(raw) - count(" \t\r\x0b\x0c")) / one, 30) / 10, math.log1p(len(words)) / 5, float(not words),
        ])
        sizes.append(len(raw))
    none = [0.0] * 10
    unary = [sum(a * b for a, b in zip([*x, *before, *after, 1.0], model.weights.tolist(), strict=True)) for x, before, after in zip(own, [none, *own[:-1]], [*own[1:], none], strict=True)]
    pair, add = model.pair.tolist(), lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    ahead = [(0.0, unary[0])]
    for u in unary[1:]:
        g, b = ahead[-1]
        ahead.append((add(g + pair[0][0], b + pair[1][0]), u + add(g + pair[0][1], b + pair[1][1])))
    back = [(0.0, 0.0)]
    for u in unary[:0:-1]:
        g, b = back[-1]
        back.append((add(pair[0][0] + g, pair[0][1] + u + b), add(pair[1][0] + g, pair[1][1] + u + b)))
    z = add(*ahead[-1])
    bad = [math.exp(a[1] + b[1] - z) for a, b in zip(ahead, back[::-1], strict=True)]
    share = sum(s * p for s, p in zip(sizes, bad, strict=True)) / max(sum(sizes), 1)
    return 1 / (1 + math.exp(-(model.curve[0] - model.curve[1] * math.sqrt(share))))


def plain_verdict(text, rules):
    """The rules in plain Python: statistics counted one by one, conditions in their order."""
    from test_texts import brute_rules

    n, chars, symbols, dup, repeat = brute_rules(text)
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    one = max(n, 1)
    value = {
        "symbol_rate": symbols / one, "upper_rate": len(re.findall("[A-Z]", text or "")) / max(chars, 1), "bang_rate": (text or "").count("!") / one,
        "run_rate": sum(a == b for a, b in zip(w[:-1], w[1:], strict=True)) / one, "dup_line_rate": dup / max(len(lines), 1), "repeat_rate": repeat / one,
        "distinct_rate": len(set(w)) / one, "mean_word": chars / one, "short_word_rate": sum(len(x) <= 1 for x in w) / one,
    }
    hit = any(all((value[c.feature] > c.threshold) == c.above for c in r.conditions) for r in rules)
    return not (n < 20 or 100 * repeat > 30 * n or hit)


def test_rules_by_brute_force(documents, labels):
    docs = documents.select("doc_id", "text")
    rules = quality_rules.learn(docs, labels)
    assert rules and all((r["kept"] is True) == plain_verdict(r["text"], rules) for r in quality_rules.judge(docs, rules).collect())


def test_pipeline_by_brute_force(spark, sf, documents, labels):
    """Every stage against plain Python; the learned weights and rules alone are taken from the operators."""
    import hashlib

    import numpy as np
    from test_texts import LIB, brute_hits

    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = workspace.written(stage(spark, docs, sf), "test")
        assert out.columns == documents.columns
        before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"] for r in out.collect()}
        if name == "n-gram Jaccard join":
            expected = {d for d, _, c in brute(sorted(before.items()), 5, 80, 100) if d == c}
        elif name == "benchmark decontamination":
            items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            expected = {d for d, t in before.items() if not brute_hits(t, items)[1]}
        elif name == "quality rules":
            rules = quality_rules.learn(docs.select("doc_id", "text"), labels)
            expected = {d for d, t in before.items() if plain_verdict(t, rules)}
        else:
            model = quality_crf.learn(docs.select("doc_id", "text"), labels)
            expected = {d for d, t in before.items() if plain_score(t, model) >= quality_crf.THRESHOLD}
        assert after == expected and 0 < len(after) <= len(before), name
        docs = out
    rows = []
    for r in docs.collect():
        ids = LIB.encode(r["text"], add_special_tokens=False).ids
        rows.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(rows)


def test_stages_with_clashing_columns(spark, sf, edge):
    docs = edge.withColumnRenamed("TEXT_CRC32", "contaminated").withColumnRenamed("size", "base_failed")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count() and stage(spark, docs.limit(0), sf).count() == 0


def test_registered(spark, sf):
    assert set(registry.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries() and set(registry.ORACLES) <= set(entry.oracle_sql())
    assert {re.match(r"op\d+", n)[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 11)}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, sf, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    rel = con.execute(registry.ORACLES[name])
    names = [d[0] for d in rel.description]
    order, rows = sorted(names), rel.fetchall()
    df = entry.queries()[name](spark, sf)
    assert sorted(df.columns) == order
    assert sorted(repr([r[c] for c in order]) for r in df.collect()) == sorted(repr([r[names.index(c)] for c in order]) for r in rows)



def test_links_through_a_row_without_id(spark):
    w = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(w)), (None, " ".join(w[6:] + [f"x{i}" for i in range(6)])), (None, None), (2, " ".join(w[12:] + [f"x{i}" for i in range(12)]))]
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["n_shingles"]}
    assert got == {(1, 1), (None, 1), (2, 1)}
