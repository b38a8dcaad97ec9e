"""Collocations against a plain count; the filter by itself."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import phrases

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, least, top):
    f, total = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 6):
                f.setdefault(lang, Counter()).update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, own in f.items():
        rows, cand = [], {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        for p, a in cand.items():
            if any(b >= a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, k = min((1_000 * a * total[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, total[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def docs():
    rnd = random.Random(2)
    bank = ["a", "b", "Ab", "éa", "x\x1cy", "日本", "c", "d" * 40]
    text = lambda n: "".join(rnd.choice(bank) + rnd.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ".\r\n", " ; "]) for _ in range(n))
    out = [(rnd.choice(["en", "de", None, "und"]), text(rnd.randint(0, 90))) for _ in range(120)]
    out += [("en", "one two three four five six. " * 40), ("en", None), (None, ""), ("en", "solo"), ("xx", "p q " * 30), ("en", text(6_000))] * 2
    return out


@pytest.mark.parametrize("limit", [None, 3])
@pytest.mark.parametrize("s", [phrases.Settings(least=8, top=25), phrases.Settings(least=3, top=10_000, buffer=50, entries=40, words_kept=5)])
def test_collocations(spark, s, limit):
    rows = docs()
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({"ids": F.lit(1), "word": F.lit(1), "f": F.lit("x")}).repartition(3)
    if limit:
        spark.conf.set("evenkeel.broadcast.rows", limit)  # vocabulary joined by shuffle
    try:
        got = sorted(tuple(r) for r in phrases.collocations(df, s).collect())
    finally:
        spark.conf.unset("evenkeel.broadcast.rows")
    want = plain(rows, s.least, s.top)
    assert got == want and len(want) > 40


def test_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", "a b c")], "lang string, text string")).count() == 0


def test_score_beyond_64_bits(spark):
    a, n, l, r = 3_000_000_007, 9_000_000_000_000_011, 5_000_000_029, 4_000_000_037
    long = lambda c: f"cast({c}L as decimal(19, 0))"
    got = spark.sql(f"select (cast(1000 as decimal(4, 0)) * {long(a)} * {long(n)}) div ({long(l)} * {long(r)}) as s").first().s
    assert got == 1_000 * a * n // (l * r)


@pytest.mark.parametrize("n", [0, 1, 300, 70_000])
def test_filter_is_lossless(n):
    rnd = np.random.default_rng(n)
    ids = [rnd.integers(1, 1 << 25, n) for _ in range(2 + n % 4)]
    if n > 1:
        ids[-1][:100] &= ~2_047  # a third word whose low bits are zero
        ids[-1][ids[-1] == 0] = 2_048
    high, low = phrases.pack(ids)
    f = phrases.Filter.of(np.concatenate([high, high]), np.concatenate([low, low]))
    g = phrases.Filter.load(f.dump())
    assert (g.high == f.high).all() and (g.low == f.low).all() and (g.counts == 2).all()
    back = phrases.unpack(*phrases.gather(g.high, g.low))
    assert {tuple(r[:len(ids)]) for r in back.tolist()} == set(zip(*(a.tolist() for a in ids)))
    assert not back[:, len(ids):].any()
    if n > 1:
        halves = phrases.Filter.merged([f.shard(0, n // 2), f, f.shard(n // 2, n)])
        assert (halves.high == f.high).all() and (halves.counts == 4).all()
        assert len(f.dump()) < n * (18 if len(ids) > 2 else 10) + 4 * 65_536 + 32


def test_permutation_is_inverted_at_its_edges():
    rnd = np.random.default_rng(1)
    high = rnd.integers(0, 1 << 63, 1_000).astype(np.uint64)
    zero = np.zeros(1_000, np.uint64)
    swapped = phrases.mix64(high + np.uint64(0x9E3779B97F4A7C15))  # would lose their low part
    for low in (zero, swapped, rnd.integers(1, 1 << 63, 1_000).astype(np.uint64)):
        h, w = phrases.scatter(high, low)
        assert ((w == 0) == (low == 0)).all()
        back = phrases.gather(h, w)
        assert (back[0] == high).all() and (back[1] == low).all()
    assert (phrases.unmix64(phrases.mix64(high)) == high).all()


def test_equal_quotients_with_different_remainders():
    high, low = np.zeros(6, np.uint64), np.asarray([5, 1, 5, 1, 3, 5], np.uint64)
    f = phrases.Filter.merged([phrases.Filter(high, low, np.ones(6, np.int64))])
    assert f.low.tolist() == [1, 3, 5] and f.counts.tolist() == [2, 1, 3]
