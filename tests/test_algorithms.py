"""Custom algorithms against brute force on small random inputs."""

import hashlib
import itertools
import math
import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import joins as J
from evenkeel.operators.components import components
from evenkeel.operators.evaluation import binomial_quantile, paired_bootstrap, paired_unit_bootstrap, promotion_gate
from evenkeel.operators.fuzzy import _common, _common_with, _letter_bits, fuzzy_candidates
from evenkeel.operators.matching import LEVELS, match_without_replacement
from evenkeel.operators.series import MIN_SAMPLES, detrend
from evenkeel.operators.spectra import power_spectrum
from evenkeel.operators.thresholds import threshold_axis, threshold_search


def best_threshold(rows):
    def axis(i):
        v = sorted({r[i] for r in rows})
        return sorted({10.0, *v, *[a + (b - a) / 2 for a, b in zip(v, v[1:])]})
    p = sum(r[2] for r in rows)
    n = len(rows) - p
    best = None
    for t1, t2 in itertools.product(axis(0), axis(1)):
        tp = sum(r[2] and r[0] > t1 and r[1] > t2 for r in rows)
        fp = sum((not r[2]) and r[0] > t1 and r[1] > t2 for r in rows)
        key = (tp * n - fp * p, min(tp * n, (n - fp) * p), -fp, -(abs(t1 - 10) + abs(t2 - 10)), t1, t2)
        best = max(best, (key, (t1, t2, tp, fp))) if best else (key, (t1, t2, tp, fp))
    return best[1]


@pytest.mark.parametrize("seed,n,m", [(1, 12, 3), (2, 40, 60), (3, 40, 6), (4, 2, 1)])
def test_threshold_search(spark, seed, n, m):
    rnd = random.Random(seed)
    rows = [(rnd.randint(-m, m) / 2.0 + 8, rnd.randint(-m, m) / 2.0, rnd.random() < 0.5) for _ in range(n)]
    rows[0], rows[1] = (*rows[0][:2], True), (*rows[1][:2], False)
    got = threshold_search(spark.createDataFrame(rows, "d01 double, d21 double, truth boolean")).first()
    assert (got.t01, got.t21, got.TP, got.FP) == best_threshold(rows)


def test_threshold_search_of_random_labels(spark):
    """Thousands of values an axis and nothing to find: the best value equals that of a sweep over all states."""
    rnd = np.random.default_rng(9)
    n = 4_000
    a, b, truth = rnd.permutation(n) / 7.0, rnd.permutation(n) / 9.0, rnd.random(n) < 0.4
    pos, neg = int(truth.sum()), int((~truth).sum())
    passing, best = np.zeros(n + 1, np.int64), 0
    at = np.argsort(np.argsort(b))
    for i in np.argsort(-a):  # one more point passes the first threshold; states of the second below its rank gain it
        passing[:at[i] + 1] += neg if truth[i] else -pos
        best = max(best, int(passing.max()))
    rows = [(float(x), float(y), bool(z)) for x, y, z in zip(a, b, truth)]
    got = threshold_search(spark.createDataFrame(rows, "d01 double, d21 double, truth boolean")).first()
    assert got.TP * neg - got.FP * pos == best
    assert got.TP == (truth & (a > got.t01) & (b > got.t21)).sum() and got.FP == (~truth & (a > got.t01) & (b > got.t21)).sum()


def test_threshold_search_needs_both_classes(spark):
    with pytest.raises(ValueError, match="both classes"):
        threshold_search(spark.createDataFrame([(1.0, 2.0, True)], "d01 double, d21 double, truth boolean"))


def test_threshold_axis(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (3.0,), (float("inf"),), (float("nan"),)], "x double")
    assert sorted(r[0] for r in threshold_axis(df, "x").collect()) == [1.0, 2.0, 3.0, 10.0]


def greedy(refs, pool):
    used, out = set(), {}
    at = {"tic": 2, "sector": 3}
    for r in sorted(refs):
        free = [c for c in pool if c[0] not in used]
        out[r[0]] = (None, "UNMATCHED", None, 0, 0)
        for name, cols in LEVELS:
            near = [c for c in free if all(c[at[k]] == r[at[k]] for k in cols)]
            if near:
                d = min(abs(c[1] - r[1]) for c in near)
                tied = sorted(c[0] for c in near if abs(c[1] - r[1]) == d)
                out[r[0]] = (tied[0], name, d, len(near), len(tied))
                used.add(tied[0])
                break
    return out


@pytest.mark.parametrize("seed,nr,npool,span", [(1, 15, 30, 6), (2, 12, 8, 3)])
def test_matching_equals_sequential_choice(spark, seed, nr, npool, span):
    rnd = random.Random(seed)
    make = lambda p, n: [(f"{p}{i:03d}", float(rnd.randint(0, span)), rnd.randint(0, 4), rnd.randint(0, 1)) for i in range(n)]
    refs, pool = make("A", nr), make("B", npool)
    out = match_without_replacement(spark.createDataFrame(refs, "ref string, value double, tic int, sector int"),
                                    spark.createDataFrame(pool, "cand string, value double, tic int, sector int"))
    assert {r.ref: (r.cand, r.level, r.difference, r.candidates, r.ties) for r in out.collect()} == greedy(refs, pool)


def test_matching_of_copies(spark):
    """All references alike: the head start keeps them from losing to one another one by one."""
    refs = [(f"A{i}", 1.0, 1, 1) for i in range(6)]
    pool = [(f"B{i}", 1.0, 1, 1) for i in range(5)]
    out = match_without_replacement(spark.createDataFrame(refs, "ref string, value double, tic int, sector int"),
                                    spark.createDataFrame(pool, "cand string, value double, tic int, sector int"), audit=False)
    assert {r.ref: r.cand for r in out.collect()} == {**{f"A{i}": f"B{i}" for i in range(5)}, "A5": None}


def test_matching_with_second_distance(spark):
    refs = [("A1", 5.0, 1.0, 7), ("A2", 5.0, 9.0, 7), ("A3", 5.0, 9.0, 8)]
    pool = [("B1", 6.0, 8.0, 7), ("B2", 4.0, 2.0, 7), ("B3", 5.5, 0.0, 9)]
    out = match_without_replacement(
        spark.createDataFrame(refs, "ref string, value double, second double, tic int"),
        spark.createDataFrame(pool, "cand string, value double, second double, tic int"),
        (("SAME", ("tic",)), ("ANY", ())), audit=False, second=True)
    assert {r.ref: (r.cand, r.level) for r in out.collect()} == {"A1": ("B2", "SAME"), "A2": ("B1", "SAME"), "A3": ("B3", "ANY")}


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_with_second_distance_and_start(spark, seed):
    """Ties of both distances go to the candidate of the smaller target and start, against sequential choice."""
    rnd = random.Random(seed)
    make = lambda p, n: [(f"{p}{i:03d}", float(rnd.randint(0, 3)), float(rnd.randint(0, 2)), rnd.randint(0, 3), rnd.randint(0, 9)) for i in range(n)]
    refs, pool, want, used = make("A", 14), make("B", 20), {}, set()
    for r in sorted(refs):
        free = [c for c in pool if c[0] not in used]
        own = [c for c in free if c[3] == r[3]] or free
        best = min(own, key=lambda c: (abs(c[1] - r[1]), abs(c[2] - r[2]), c[3], c[4], c[0]), default=None)
        want[r[0]] = best and best[0]
        used.add(best and best[0])
    out = match_without_replacement(
        spark.createDataFrame(refs, "ref string, value double, second double, tic int, start int").drop("start"),
        spark.createDataFrame(pool, "cand string, value double, second double, tic int, start int"),
        (("SAME", ("tic",)), ("ANY", ())), audit=False, second=True, tie=("tic", "start"))
    assert {r.ref: r.cand for r in out.collect()} == want


def test_components_of_a_chain_and_random_edges(spark):
    rnd = random.Random(4)
    nodes = [f"n{i:03d}" for i in range(60)]
    edges = [(nodes[i], nodes[i + 1]) for i in range(24)] + [tuple(rnd.sample(nodes[30:], 2)) for _ in range(15)]
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    got = components(spark.createDataFrame([(n,) for n in nodes], "node string"),
                     spark.createDataFrame(edges, "left string, right string"))
    assert {r.node: r.component for r in got.collect()} == {n: find(n) for n in nodes}


def test_fuzzy_equals_all_pairs(spark):
    rnd = random.Random(9)
    words = ["quasi", "periodic", "pulsation", "flare", "solar", "the", "of", "in"]
    titles = sorted({" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6))) for _ in range(40)})
    prof = [(t, rnd.choice(["x", "y", ""]), "2020", f"H{i:03d}", 1) for i, t in enumerate(titles)]
    want = set()
    for a, b in itertools.combinations(sorted(prof, key=lambda p: p[3]), 2):
        r = SequenceMatcher(None, a[0], b[0]).ratio()
        if r >= 0.8 or (r >= 0.6 and a[1] and a[1] == b[1]):
            want.add((a[3], b[3], round(r, 9)))
    df = spark.createDataFrame(prof, "title_norm string, author string, year string, min_node string, nodes bigint")
    got = {(r.left, r.right, round(r.similarity, 9)) for r in fuzzy_candidates(df, block=7).collect()}
    assert got == want


def test_common_subsequence_bound():
    assert _common("abcde", "xaxcxe") == 3 and _common("", "abc") == 0 and _common("aaaa", "aa") == 2


def test_common_with_many_equals_one_by_one():
    """Lengths around whole bytes: no carry may reach the next title."""
    rnd = random.Random(12)
    text = lambda n: "".join(rnd.choice("ab c9") for _ in range(n))
    for _ in range(60):
        others = ["", "a" * 8, *[text(rnd.choice([0, 1, 7, 8, 9, 15, 16, 17, 60, 200])) for _ in range(rnd.randint(0, 12))], "b" * 16]
        b = rnd.choice(["", "a" * 20, "z", text(rnd.randint(1, 80))])
        assert _common_with(b, others, [_letter_bits(x) for x in others]).tolist() == [_common(x, b) for x in others]


def test_fuzzy_packs_of_many_passes(spark, monkeypatch):
    """Titles of one block that need several passes, with an empty one and one that is longer than a pass."""
    from evenkeel.operators import fuzzy
    monkeypatch.setattr(fuzzy, "PACK", 40)
    titles = ["", "flare", "flares", "solar flare", "solar flares", "quasi periodic solar flares of the sun", "quasi periodic solar flare of the sun", "x9"]
    prof = pd.DataFrame([(t, "x", "2020", f"H{i}", 1) for i, t in enumerate(titles)], columns=["title_norm", "author", "year", "min_node", "nodes"])
    both = pd.concat([prof.assign(side=k, block=0) for k in (0, 1)])
    got = {(r.left, r.right) for r in fuzzy._compare(0.8, 0.6)(both).itertuples()}
    want = {(f"H{i}", f"H{j}") for i, j in itertools.combinations(range(len(titles)), 2) if SequenceMatcher(None, titles[i], titles[j]).ratio() >= 0.6}
    assert got == want and len(want) >= 4


@pytest.mark.parametrize("piece", [1 << 20, 900])
def test_fuzzy_of_long_titles_reads_few_pairs(monkeypatch, piece):
    """From 200 characters on the ratio starts only at rare characters: all pairs that it finds, hardly any other one is read in full."""
    from evenkeel.operators import fuzzy
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice(["the", "on", "er", "re", "ti", "an", "ha", "es", "st", "ou", "nd", "ing"]) for _ in range(rnd.randint(1, 3)))
    titles = []
    for _ in range(30):
        w = [word() for _ in range(rnd.randint(28, 60))]
        for c in rnd.sample("bcfjkmpqvxz", rnd.randint(0, 6)):
            w.insert(rnd.randrange(len(w)), c + word())
        near = list(w)
        for k in rnd.sample(range(len(w)), rnd.randint(1, len(w) // 3)):
            near[k] = word()
        titles += [" ".join(w), " ".join(near)]
    rnd.shuffle(titles)
    prof = pd.DataFrame([(t, rnd.choice("xy"), "2020", f"H{i:03d}", 1) for i, t in enumerate(titles)], columns=["title_norm", "author", "year", "min_node", "nodes"])
    both = pd.concat([prof.assign(side=k, block=0) for k in (0, 1)])
    read, common = [], fuzzy._common_with
    monkeypatch.setattr(fuzzy, "PIECE", piece, raising=False)
    monkeypatch.setattr(fuzzy, "_common_with", lambda b, others, bits: (read.extend(others), common(b, others, bits))[1])
    got = {(r.left, r.right, r.similarity, r.basis) for r in fuzzy._compare(0.8, 0.6)(both).itertuples()}
    want = set()
    for a, b in itertools.combinations(prof.itertuples(), 2):
        ratio = SequenceMatcher(None, a.title_norm, b.title_norm).ratio()
        if ratio >= 0.8 or (ratio >= 0.6 and a.author == b.author):
            want.add((a.min_node, b.min_node, ratio, "HIGH_SIMILARITY" if ratio >= 0.8 else "SAME_AUTHOR_AND_YEAR"))
    assert got == want and len(want) >= 8 and len([t for t in titles if len(t) >= 200]) > 20 > len([t for t in titles if len(t) < 200]) > 2
    assert len(read) < 300  # of 1,770 pairs


def test_fuzzy_groups_of_letters(monkeypatch):
    """Short titles of few letters, so that groups of letters split and letters repeat more often than a number has bits."""
    from evenkeel.operators import fuzzy
    monkeypatch.setattr(fuzzy, "BATCH", 7, raising=False)
    monkeypatch.setattr(fuzzy, "PAIRS", 50, raising=False)
    rnd = random.Random(22)
    text = lambda n: "".join(rnd.choice("aaab c") for _ in range(n)).strip()
    titles = [text(rnd.choice([0, 1, 5, 30, 90, 120, 150])) for _ in range(40)] + ["a" * 90, "a" * 70 + "b" * 20]
    titles = sorted({*titles, *("".join(c for c in t if rnd.random() > 0.1) for t in titles)})
    prof = pd.DataFrame([(t, rnd.choice(["x", ""]), "2020", f"H{rnd.randrange(10**6):06d}", 1) for t in titles], columns=["title_norm", "author", "year", "min_node", "nodes"])
    half = len(prof) // 2
    got = set()
    for x, y in ((0, 0), (0, 1), (1, 1)):
        side = [prof[:half].assign(block=0), prof[half:].assign(block=1)]
        got |= {(r.left, r.right, r.similarity) for r in fuzzy._compare(0.8, 0.6)(pd.concat([side[x].assign(side=0), side[y].assign(side=1)])).itertuples()}
    want = set()
    for a, b in itertools.combinations(prof.sort_values("min_node").itertuples(), 2):
        ratio = SequenceMatcher(None, a.title_norm, b.title_norm).ratio()
        if ratio >= 0.8 or (ratio >= 0.6 and a.author == b.author != ""):
            want.add((a.min_node, b.min_node, ratio))
    assert got == want and len(want) >= 15


def test_nearest_tie_takes_lowest_index(spark):
    m = spark.createDataFrame([("s", 5.0, 1), ("s", 100.0, 2), ("s", -3.0, 3)], "k string, t double, m int")
    s = spark.createDataFrame([("s", 6.0, 0), ("s", 4.0, 1), ("s", 4.0, 7), ("s", float("nan"), 9)], "k string, t double, idx int")
    got = {r.m: (r.idx, r.residual) for r in J.nearest_join(m, s, ["k"]).collect()}
    assert got == {1: (0, 1.0), 2: (0, -94.0), 3: (1, 7.0)}


def test_containment_reports_double_match(spark):
    ev = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, 50.0)], "id int, t double")
    iv = spark.createDataFrame([("a", 0.0, 6.0), ("b", 5.0, 10.0)], "name string, s double, e double")
    got = {r.id: (r.matches, r.name) for r in J.containment_join(ev, iv, ["id"], "t", "s", "e", "name").collect()}
    assert got == {1: (2, None), 2: (1, "b"), 3: (0, None)}


def test_power_spectrum_equals_fft(spark):
    rnd = np.random.default_rng(3)
    y = rnd.normal(5, 1, 31)
    df = spark.createDataFrame([("s", i, 20.0 * i, float(v)) for i, v in enumerate(y)], "series string, pos bigint, t double, y double")
    got = {r.k: r.power for r in power_spectrum(df, ["series"]).collect()}
    z = (y - y.mean()) / y.mean() * np.hanning(31)
    want = np.abs(np.fft.fft(z)) ** 2
    assert np.allclose([got[k] for k in range(1, 16)], want[1:16])


def test_detrend_of_a_line_is_one(spark):
    df = spark.createDataFrame([("s", i, 20.0 * i, 3.0 + 0.5 * i) for i in range(MIN_SAMPLES)], "k string, idx bigint, t double, y double")
    assert all(abs(r.residual - 1.0) < 1e-12 for r in detrend(df, ["k"]).collect())


def test_bootstrap_keeps_stratum_sizes(spark):
    rows = [("s" if i < 20 else "z", i % 2 == 0, i % 3 == 0, i % 5 == 0) for i in range(27)] + [(None, True, None, True)]
    df = spark.createDataFrame(rows, "g string, truth boolean, a boolean, b boolean")
    got = paired_bootstrap(df, ["g"], 7, "x", F.col("a"), F.col("b")).collect()
    assert len(got) == 7
    for r in got:
        assert r.base_TP + r.base_FN + r.base_TN + r.base_FP == 28
        assert r.base_TP + r.base_FN == r.candidate_TP + r.candidate_FN
    assert paired_bootstrap(df.limit(0), ["g"], 7, "x", F.col("a"), F.col("b")).count() == 0


def test_bootstrap_has_the_distribution_of_direct_draws(spark):
    """Mean, deviation and correlation of the counts against drawing units one by one."""
    rnd = np.random.default_rng(5)
    rows = [(str(g), bool(t), bool(a), bool(b)) for g, n in (("x", 60), ("y", 7)) for t, a, b in rnd.random((n, 3)) < [0.3, 0.5, 0.8]]
    df = spark.createDataFrame(rows, "g string, truth boolean, a boolean, b boolean")
    cells = ["base_TP", "base_FP", "base_TN", "candidate_TP", "candidate_FN"]
    got = np.asarray([[r[c] for c in cells] for r in paired_bootstrap(df, ["g"], 6_000, "s", F.col("a"), F.col("b")).collect()], float)
    want = []
    for _ in range(6_000):
        drawn = [own[i] for g in "xy" for own in [[r for r in rows if r[0] == g]] for i in rnd.integers(0, len(own), len(own))]
        want.append([sum(t and a for _, t, a, b in drawn), sum(not t and a for _, t, a, b in drawn), sum(not t and not a for _, t, a, b in drawn),
                     sum(t and b for _, t, a, b in drawn), sum(t and not b for _, t, a, b in drawn)])
    want = np.asarray(want, float)
    assert np.abs(got.mean(axis=0) - want.mean(axis=0)).max() < 0.25
    assert np.abs(got.std(axis=0) - want.std(axis=0)).max() < 0.15
    assert np.abs(np.corrcoef(got.T) - np.corrcoef(want.T)).max() < 0.06


def test_unit_bootstrap_draws_every_unit_of_every_replicate(spark):
    """Counts equal those of drawing the units one by one with the same hashes; strata go beyond one block of draws."""
    rnd = random.Random(3)
    rows = [(g, *(rnd.random() < 0.5 for _ in "tab")) for g, n in (("x", 300), ("y", 5)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, truth boolean, a boolean, b boolean")
    want = []
    for rep in range(4):
        drawn = []
        for g in "xy":
            own = sorted(r[1:] for r in rows if r[0] == g)
            drawn += [own[int(hashlib.sha256(f"s|{rep}|{g}|{k}".encode()).hexdigest()[:13], 16) % len(own)] for k in range(len(own))]
        want.append((rep, *(sum(t == x and d[i] == y for d in drawn for t in d[:1]) for i in (1, 2)
                            for x, y in ((True, True), (True, False), (False, False), (False, True)))))
    got = paired_unit_bootstrap(df, ["g"], 4, "s", F.col("a"), F.col("b"))
    assert sorted(tuple(r)[:9] for r in got.collect()) == want
    assert paired_unit_bootstrap(df.limit(0), ["g"], 4, "s", F.col("a"), F.col("b")).count() == 0


def test_binomial_quantile():
    for n, p in ((1, 0.5), (9, 0.03), (40, 0.7), (5_000, 0.4), (0, 0.3), (6, 0.0), (6, 1.0)):
        mass = [math.comb(n, k) * p**k * (1 - p) ** (n - k) if n < 1_000 else math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p))
                for k in range(n + 1)]
        total = np.cumsum(mass) / np.sum(mass)
        u = np.asarray([0.0, 1e-9, 0.013, 0.5, 0.77, 0.9999, 1 - 1e-12])
        want = [min(int((total < x).sum()), n) for x in u]
        got = binomial_quantile(u, np.full(len(u), n), np.full(len(u), p))
        assert list(got[1:]) == want[1:] and (p in (0.0, 1.0) or n == 5_000 or got[0] == want[0])


@pytest.mark.parametrize("gain,ba,sens,spec,want", [
    (0.025, 0.001, -0.02, -0.02, True), (0.0249, 0.001, -0.02, -0.02, False), (0.03, 0.0, -0.02, -0.02, False),
    (0.03, 0.001, -0.025, -0.02, False), (0.03, 0.001, -0.02, -0.025, False)])
def test_gate_needs_all_criteria(spark, gain, ba, sens, spec, want):
    iv = spark.createDataFrame([("d_balanced_accuracy", ba, 1.0), ("d_sensitivity", sens, 1.0), ("d_specificity", spec, 1.0)],
                               "metric string, lower double, upper double")
    point = spark.createDataFrame([(gain, -7.5, -4.4)], "gain double, t01 double, t21 double")
    r = promotion_gate(iv, point).first()
    assert r.promoted is want and r.final_t01 == (-7.5 if want else 10.0)


def test_reconcile(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, None, 2.0), (3, "z", 3.0)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "y", 1.0 + 1e-13), (2, None, 2.5), (4, "w", 0.0)], "k int, s string, v double")
    got = {(r.k, r.field) for r in J.reconcile(a, b, ["k"], ["s", "v"], tol=1e-9).collect()}
    assert got == {(1, "s"), (2, "v"), (3, "*row*"), (4, "*row*")}
