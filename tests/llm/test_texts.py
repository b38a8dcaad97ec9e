"""Operators on whole texts: token counts, packing, packed ids, decontamination, quality."""

import random
import zlib

import brute
import numpy as np
import pytest
from data import documents, empty, pairs
from pyspark.sql import functions as F

from evenkeel.llm import decontaminate, packing, quality, queries, tokencount
from evenkeel.suite.registry import Tables

SMALL = "/root/testdata/sf0.01"


def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.token_file())


def test_automaton_counts_greedy_pieces():
    rnd = random.Random(1)
    for _ in range(300):
        pieces = {"".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(1, 25))} | {"_ab", "_"}
        automaton = tokencount.Automaton(pieces)
        for _ in range(20):
            word = "".join(rnd.choice("abcéz") for _ in range(rnd.randint(0, 14)))
            assert automaton.count("_" + word) == brute.greedy_tokens(word or " ", pieces, "_")[1] if word else True


def test_token_counts(spark):
    pieces = tokencount.sentencepiece_pieces(queries.token_file("piece_bpe_32k.model"))
    df = documents(spark).withColumn("n_tokens", F.lit("clash")).withColumn("other", F.lit(1))
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in tokencount.token_counts(df, pieces).collect()}
    assert got == {i: brute.greedy_tokens(t, set(pieces), tokencount.MARKER) for i, t in pairs()}
    assert tokencount.token_counts(empty(spark), pieces).count() == 0


@pytest.mark.parametrize("window", [16, 100])
def test_best_fit_decreasing(window):
    rnd = np.random.default_rng(window)
    for n in (0, 1, 5, 200):
        lengths = rnd.integers(1, window + 1, n)
        bins, offsets, used = packing.best_fit_decreasing(lengths, window)
        fill = [0] * used
        for k in np.lexsort((offsets, bins)):
            assert offsets[k] == fill[bins[k]]
            fill[bins[k]] += lengths[k]
        assert sorted(map(int, fill)) == brute.best_fit(lengths.tolist(), window)


def test_packing_round_trip(spark):
    s = packing.Packing(queries.token_file(), window=128, run_tokens=3_000)
    df = documents(spark)
    df = df.unionByName(df.where("doc_id = 3")).withColumn("sequence_id", F.lit(-1))
    rows = packing.pack(df, s).collect()
    t, docs = tokenizer(), dict(pairs())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for i, own in by_doc.items():
        want = [*t.encode(docs[i] or "", add_special_tokens=False).ids, 0]
        copies = 2 if i == 3 else 1
        got = sorted((r.start, list(np.frombuffer(r.ids, "<u4"))) for r in own)
        assert all(r.doc_tokens == len(want) and r.length * 4 == len(r.ids) for r in own)
        assert [x for start, ids in got[::copies] for x in ids] == want
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= 128
    total = sum(r.length for r in rows)
    assert len(by_sequence) * 128 - total < 0.1 * total
    digests = packing.pack_digests(df, s).collect()
    key = lambda r: (r.doc_id, r.start, r.sequence_id)
    assert [(key(r), zlib.crc32(r.ids)) for r in sorted(rows, key=key)] == [(key(r), r.ids_crc32) for r in sorted(digests, key=key)]
    assert packing.pack(empty(spark), s).count() == 0


def test_encoder_on_runs_of_blanks():
    for text in (" " * 300_000 + "a", "\n" * 1_000, "a" * 5_000, "<|endoftext|> <|endoftext|>x"):
        assert np.frombuffer(packing.Encoder(queries.token_file())(text), "<u4").tolist() == tokenizer().encode(text, add_special_tokens=False).ids


def test_packed_matrix_round_trip(spark):
    s = packing.Packing(queries.token_file(), window=64, end_id=50256)
    packed = packing.packed_matrix(documents(spark), s, pad_id=7)
    t = tokenizer()
    ids = {}
    for r in packing.unpack(packed).orderBy("start").collect():
        ids.setdefault(r.doc_id, []).extend(r.ids)
    assert ids == {i: [*t.encode(x or "", add_special_tokens=False).ids, 50256] for i, x in pairs()}
    for r in packed.collect():
        line, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(line) == len(places) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert (line[r.n_tokens:] == 7).all()
        ends = [*r.cu_seqlens, *([64] if r.n_tokens < 64 else [])]
        assert places.tolist() == [k for a, b in zip(ends, ends[1:]) for k in range(b - a)]
    with pytest.raises(Exception, match="does not fit"):
        packing.packed_matrix(documents(spark), s, dtype="<u1").collect()
    assert packing.packed_matrix(empty(spark), s).count() == 0


ITEMS = [(1, None), (2, ""), (3, "  ...  "), (4, "kurz"), (4, "kurz"), (None, "kurz")]


@pytest.mark.parametrize("block_chars", [10**9, 200])
def test_decontamination(spark, block_chars):
    docs = pairs()
    leak = docs[3][1].replace("\n", "  ").upper().split(" ")
    items = [*ITEMS, (10, " ".join(leak[:25])), (11, " ".join(leak[4:13])), (12, "er er er"), (13, docs[5][1]), (14, docs[5][1])]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    df = documents(spark).withColumn("n_words", F.lit("clash"))
    got = decontaminate.hits(df, table, block_chars=block_chars)
    named = [x for x in items if x[0] is not None]
    want = {i: brute.contamination(t, named) for i, t in docs}
    assert {r.doc_id: (r.n_words, r.hit_words, r.item_ids) for r in got.collect()} == want
    for r in decontaminate.summary(got).collect():
        n, hit, names = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, len(hit), len(names), brute.sha(",".join(names)), bool(hit))
    assert any(hit for _, hit, _ in want.values())


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert not decontaminate.hits(documents(spark), none).where(F.size("hit_words") > 0).count()
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontaminate.hits(empty(spark), items).count() == 0


def test_quality_on_held_out_rows(spark):
    t = Tables(spark, SMALL)
    got = queries.QUERIES["op10_quality"](spark, SMALL)
    assert got.count() == t.documents.count()
    rows = got.join(t.labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.collect())


def test_quality_scores_are_sparse_dot_products(spark):
    s = quality.Settings(bits=8, scale=3.0)
    weights = np.random.default_rng(2).normal(size=256).astype(np.float32)
    model = quality.Model(weights.tobytes(), 0.5, s)
    df = documents(spark).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    features = quality.Features(8)
    for i, text in pairs():
        idx = features(text)
        x = sum(float(weights[k]) for k in idx) / len(idx) if len(idx) else 0.0
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(0.5 + 3 * x))), abs=1e-6)


def test_quality_without_labels(spark):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, quality int")
    model = quality.fit(documents(spark), none)
    assert {r.score for r in quality.score(documents(spark), model).collect()} == {0.5}
    assert quality.score(empty(spark), model).count() == 0


def test_repeated_words_are_one_feature():
    features = quality.Features(18)
    assert set(features("Er Er Er Er")[1:4]) == set(features("Wh Wh Wh Wh")[1:4])
    assert len(features("a b c")) == 5 and len(features(None)) == len(features("")) == 0


def test_near_dedup_recall_of_planted_copies():
    """The four-bit contract keeps copies with little changed and, as the README states, misses many at Jaccard 0.8 to 0.9."""
    import random

    from evenkeel.llm import simhash
    rnd = random.Random(9)
    near = {1: [], 6: []}
    for _ in range(60):
        w = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
        for n, found in near.items():
            v = list(w)
            for k in rnd.sample(range(300), n):
                v[k] = "neu%d" % rnd.randrange(10**6)
            found.append((simhash.fingerprint(" ".join(w)) ^ simhash.fingerprint(" ".join(v))).bit_count() <= simhash.MAX_BITS)
    assert sum(near[1]) >= 0.6 * 60
    assert sum(near[6]) < sum(near[1])


def test_learner_equals_a_plain_loop(spark):
    """Follow-the-regularised-leader, row by row in hash order, with plain numbers and dictionaries."""
    import math
    from collections import Counter
    docs = [(i, t) for i, t in pairs() if t is not None][:30]
    docs += docs[:2]  # repeated rows are learned from once more
    labels = [(i, i % 2) for i, _ in docs[:30]] + [(4, 1), (None, 1), (900, 1), (3, None)]
    s = quality.Settings(bits=10, l1=0.02)
    model = quality.fit(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int"), s)
    order = [r.id for r in spark.createDataFrame([(i,) for i, _ in docs[:30]], "id bigint").orderBy(F.xxhash64("id"), "id").collect()]
    features, z, n = quality.Features(s.bits), Counter(), Counter()

    def weight(j):
        free = max(0.0, abs(z[j]) - s.l1)
        return -math.copysign(free, z[j]) / ((s.beta + math.sqrt(n[j])) / s.alpha + s.l2)

    for i in order:
        for text in (t for k, t in sorted(docs) if k == i):
            idx = features(text).tolist()
            x = {j: c * s.scale / max(1, len(idx)) for j, c in Counter(idx).items()} | {"bias": 1.0}
            w = {j: weight(j) for j in x}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[j] * v for j, v in x.items())))))
            for j, v in x.items():
                g = (p - (0.0 if i == 4 else float(i % 2))) * v
                z[j] += g - (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / s.alpha * w[j]
                n[j] += g * g
    want = np.asarray([weight(j) for j in range(1 << s.bits)])
    assert np.allclose(model.array(), want, atol=1e-5) and abs(model.bias - weight("bias")) < 1e-9 and np.abs(want).max() > 0.01


def test_repeated_rows_and_clashing_columns(spark):
    """Each of the rows that repeat an id and text has the same result, and columns named like outputs are replaced."""
    df = documents(spark).where("doc_id < 8")
    twice = df.unionByName(df).withColumns({"n_tokens": F.lit("clash"), "score": F.lit("clash"), "n_words": F.lit(-1)})
    counts = tokencount.token_counts(twice, tokencount.sentencepiece_pieces(queries.token_file("piece_bpe_32k.model"))).collect()
    model = quality.Model(np.linspace(-1, 1, 1 << 10, dtype=np.float32).tobytes(), 0.1, quality.Settings(bits=10))
    scored = quality.score(twice, model).collect()
    for rows, column in ((counts, "n_tokens"), (scored, "score")):
        own = {}
        for r in rows:
            own.setdefault(r.doc_id, []).append(r[column])
        assert len(rows) == 16 and all(len(v) == 2 and v[0] == v[1] and v[0] != "clash" for v in own.values())
    tokens = lambda docs: {r.doc_id: r.n for r in packing.unpack(packing.packed_matrix(docs, queries.packing_settings())).groupBy("doc_id").agg(
        F.sum(F.size("ids")).alias("n")).collect()}
    assert tokens(twice) == {i: 2 * n for i, n in tokens(df).items()}
