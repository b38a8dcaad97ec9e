"""Operators that compare documents, lines, vectors and URLs."""

import random

import brute
import numpy as np
import pytest
from data import documents, empty, pairs
from pyspark.sql import functions as F

from evenkeel.llm import lines, queries, simhash, substrings, topk, urls


def test_golay_keys_meet_at_four_bits():
    rnd = np.random.default_rng(0)
    a = rnd.integers(0, 2**64, 3_000, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rnd.integers(0, 64, len(b)).astype(np.uint64)
    keys = simhash.Keys()
    sets = []
    for x in (a, b):
        rows, found = keys(x)
        own = [set() for _ in x]
        for r, k in zip(rows.tolist(), found.tolist()):
            own[r].add(k)
        sets.append(own)
    assert all(x & y for x, y in zip(*sets))


def test_simhash_classes(spark):
    df = documents(spark).withColumn("component_id", F.lit("clash")).withColumn("fingerprint", F.lit(0))
    df = df.unionByName(df.where("doc_id = 3"))
    got = simhash.classes(df).collect()
    want = brute.near_classes(pairs())
    assert len(got) == len(want) + 1 and {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) <= len(want) - 5
    kept = sorted(r.doc_id for r in simhash.keep_one(df).collect())
    assert kept == sorted({c for _, c in want.values()})
    assert simhash.classes(empty(spark)).count() == 0


@pytest.mark.parametrize("cell_rows", [4, 2_048])
def test_links_of_one_large_group(spark, cell_rows):
    """Fingerprints around one centre: keys of many nodes are split, and only a forest comes back."""
    rnd = random.Random(7)
    prints = set()
    for _ in range(300):
        x = 0x123456789ABCDEF0
        for b in rnd.sample(range(64), rnd.choice([1, 2, 3, 6])):
            x ^= 1 << b
        prints.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "node bigint"), cell_rows).collect()
    mask, g, h = (1 << 64) - 1, brute.Groups(), brute.Groups()
    for r in found:
        assert ((r.left ^ r.right) & mask).bit_count() <= 4
        g.join(r.left, r.right)
    for i, a in enumerate(signed):
        for b in signed[i + 1:]:
            if ((a ^ b) & mask).bit_count() <= 4:
                h.join(a, b)
    assert [g.find(x) for x in signed] == [h.find(x) for x in signed]
    if cell_rows > 300:
        assert len(found) < 300 * spark.sparkContext.defaultParallelism


def test_null_ids_have_no_say_in_classes(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (None, "x y z")], "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.classes(df).collect()} == {(None, 7), (7, 7), (None, None)}
    assert simhash.keep_one(df).count() == 3


@pytest.mark.parametrize("parts", [1, 7])
def test_repeated_ids_leave_a_fixed_row(spark, parts):
    """Rows of one id with different texts: the smallest text stays, then the smallest row; a null text is the smallest."""
    rows = [(5, "m n o p q", "x"), (5, "b c d e f", "z"), (5, "b c d e f", "y"), (6, "b c d e f", "w"), (7, None, "v"), (7, "t u v w x", "u")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(parts)
    got = sorted((r.doc_id, r.text or "", r.lang) for r in simhash.keep_one(df).collect())
    assert got == [(5, "b c d e f", "y"), (7, "", "v")]


def test_line_dedup(spark):
    docs = [*pairs(), (900, "Page one of nine is here today now and there it ends so\nPage two of nine is here today now and there it ends so"),
            (901, "a\n\na\n  \nA!"), (902, " ".join(f"word{k}" for k in range(1_300))), (903, " ".join(f"word{k}" for k in range(1_299)) + " zz"), (906, "a.b" * 3_000 + " c d"),
            (904, "\n"), (905, "Kurz,\nkurz")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("kept_text", F.lit(1)).withColumn("other", F.lit(2))
    got = {r.doc_id: (r.kept_text, r.n_lines, r.n_removed) for r in lines.dedup(df).collect()}
    want = brute.line_dedup(docs)
    assert got == want
    assert want[901] == ("a\n\n  ", 5, 2) and want[903] == ("", 1, 1) and want[900][2] == 1  # whole lines, however long
    assert lines.dedup(empty(spark)).count() == 0


def test_line_groups_hold_without_all_pairs(spark):
    rnd = random.Random(3)
    base = [f"word{k}" for k in range(60)]
    docs = []
    for i in range(40):
        w = list(base)
        for k in rnd.sample(range(60), rnd.choice([1, 2, 3, 8])):
            w[k] = f"x{rnd.randint(0, 50)}"
        docs.append((i, " ".join(w)))
    got = {r.doc_id: (r.kept_text, r.n_lines, r.n_removed)
           for r in lines.dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == brute.line_dedup(docs)


def test_line_dedup_of_repeated_rows_and_null_ids(spark):
    rows = [(5, "same line here"), (5, "same line here"), (6, "same line here"), (None, "other words now"), (8, "other words now")]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), r.kept_text) for r in got) == [
        ("5", "same line here"), ("5", "same line here"), ("6", ""), ("8", ""), ("None", "other words now")]


@pytest.mark.parametrize("window, seed", [(5, 2), (8, 8), (50, 16)])
def test_substring_dedup(spark, window, seed):
    df = documents(spark).withColumn("n_words", F.lit("clash")).withColumn("block", F.lit(1))
    s = substrings.Settings(window=window, seed=seed, readers=3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.dedup(df, s).collect()}
    want = brute.substring_dedup(pairs(), window)
    assert got == want
    assert sum(n for _, n, _ in want.values()) > 150
    assert substrings.dedup(empty(spark), s).count() == 0


def test_substring_runs_from_many_sources(spark):
    """Short alphabets: runs repeat everywhere, inside texts too, and seldom in the block of their anchor."""
    rnd = random.Random(11)
    docs = [(i, " ".join(rnd.choice("ab" if i % 2 else "abc") for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for window in (4, 7):
        got = substrings.dedup(df, substrings.Settings(window=window, seed=2, readers=2))
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got.collect()} == brute.substring_dedup(docs, window)


def test_substring_dedup_of_repeated_rows_and_null_ids(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (6, "x a b c d"), (None, "a b c d"), (7, None)]
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), substrings.Settings(window=3, seed=2)).collect()
    assert sorted((str(r.doc_id), r.kept_text) for r in got) == [
        ("5", "a b c d"), ("5", "a b c d"), ("6", "x"), ("7", ""), ("None", "a b c d")]


def vectors(n=700, dims=8):
    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rnd.normal(size=dims) * (1 + i % 3), 2)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(120)]  # a large group of equal vectors: ties
    rows += [(2_000, None), (None, rows[1][1]), (2_050, []), (2_100, [float("nan")] * dims), (2_150, [1.0] * (dims + 1)),
             (2_151, [2.0] * (dims + 1)), (2_200, [None, *[1.0] * (dims - 1)]), (2_250, [float("inf")] * dims), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize("s", [topk.Settings(page=8, fan_out=3, tree_rows=100, query_rows=6), topk.Settings()])
def test_top_k(spark, s):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("clash")).repartition(3)
    fine = [(i, np.floor(256 * np.asarray(v, np.float32).astype(float)).astype(int)) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for i, q in fine:
        if i % 50 == 0:
            near = sorted((-int(v @ q), j) for j, v in fine if j != i and len(v) == len(q))[:5]
            want |= {(i, k, j, -x) for k, (x, j) in enumerate(near, 1)}
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, s).collect()
    assert len(got) == len(want) and {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want


def test_top_k_of_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(50, [1.0])], "vec_id bigint, embedding array<float>")
    assert topk.top_k(one, F.col("vec_id") % 50 == 0).count() == 0


URLS = [None, "", "no scheme", "http://COM/a", "https://www.Example.com/en/1?x#y", "http://a.example.com/en/", "http://example.com/en",
        "http://net/es/1", "x://net", "http://xnet/es/", "http://a.b.net/fr/?q", "://net/fr/", "http://u:p@a.com:80/x", "a://b://c/d",
        "http://www.example.com/de/#a", "HTTP://ÄÖ.example.org/straße/", "http://" + "a." * 2_000 + "net/es/" + "b" * 20_000, "http://line\nbreak.com/a\nb?c"]


def test_url_rules(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(0, URLS[3])] * 2
    df = spark.createDataFrame(rows, "page_id int, url string").withColumn("host", F.lit(1)).withColumn("label", F.lit(1)).withColumn("features", F.lit(1))
    model = urls.fit(urls.default_labels(spark))
    got = urls.judge(df, model, queries.URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = brute.url_parts(r.url)
        rule = brute.url_rule(host, path, queries.URL_RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        assert r.verdict == (rule[1] if rule else "block" if r.block_chance >= 0.5 else "allow")
    assert urls.judge(df.limit(0), model, queries.URL_RULES).count() == 0


def test_url_classifier_on_new_urls_of_known_names(spark):
    model = urls.fit(urls.default_labels(spark))
    bad = [f"https://{h}.example.org/en/{n}" for n in (3, 5_000) for h in ("casino-win", "free-bets", "cheap-pills", "adult-x", "spam-farm", "ads-track")]
    good = [f"http://{h}.example.org/de/{n}.html" for n in (8, 7_001) for h in ("therst", "www.ththon", "blog.library", "m.garden")]
    df = spark.createDataFrame([(u,) for u in bad + good], "url string")
    got = {r.url: r.verdict for r in urls.judge(df, model, ()).collect()}
    assert {got[u] for u in bad} == {"block"} and {got[u] for u in good} == {"allow"}


def test_bounds_of_the_tree_save_distances():
    """On clustered vectors a search computes a small share of all distances, and finds what a scan finds."""
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(30, 16))
    rows = np.floor(256 * (centres[rnd.integers(0, 30, 6_000)] + 0.1 * rnd.normal(size=(6_000, 16))))
    tree, searches = topk.MTree(np.arange(6_000), rows, topk.Settings()), range(0, 6_000, 200)
    for i in searches:
        ids, scores = tree.search(i, rows[i], -np.inf)
        products = (rows @ rows[i]).astype(int)
        products[i] = -(1 << 60)
        want = np.lexsort((np.arange(6_000), -products))[:5]
        assert ids.tolist() == want.tolist() and scores.tolist() == products[want].tolist()
    assert tree.computed < 0.15 * len(searches) * 6_000


def test_url_classifier_on_held_out_host_names(spark):
    """Whole host names are held out in turn; what is learned from the others still tells most of them (68 %; 55 % by the larger class)."""
    name = lambda u: u.split("//")[1].split("/")[0].removeprefix("www.").removeprefix("m.").removeprefix("blog.").split(".")[0]
    names = sorted({name(u) for u, _ in urls.LABELLED})
    right = total = 0
    for fold in range(4):
        out = {n for k, n in enumerate(names) if k % 4 == fold}
        model = urls.fit(spark.createDataFrame([r for r in urls.LABELLED if name(r[0]) not in out], "url string, label int"))
        test = [r for r in urls.LABELLED if name(r[0]) in out]
        got = {r.url: r.verdict for r in urls.judge(spark.createDataFrame([(u,) for u, _ in test], "url string"), model, ()).collect()}
        right += sum((got[u] == "block") == bool(y) for u, y in test)
        total += len(test)
    assert total == len(urls.LABELLED) and right / total >= 0.65
