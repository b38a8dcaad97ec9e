"""Matching by groups first: the pairs of a plain loop, and few rounds for many equal wishes."""

import random

import pytest

from evenkeel.operators import matching as M


def plain(refs, pool, levels, second):
    """References choose one after the other; rows are dicts."""
    free, out = sorted(pool, key=lambda c: c["cand"]), {}
    for r in sorted(refs, key=lambda r: r["ref"]):
        for name, cols in levels:
            here = [c for c in free if all(c[x] == r[x] for x in cols)]
            if here:
                d = lambda c: (abs(c["value"] - r["value"]), abs(c["second"] - r["second"]) if second else 0.0)
                best = min(here, key=lambda c: (*d(c), c["cand"]))
                free.remove(best)
                out[r["ref"]] = (best["cand"], name, len(here), sum(d(c)[0] == d(best)[0] for c in here))
                break
        else:
            out[r["ref"]] = (None, "UNMATCHED", 0, 0)
    return out


def run(spark, refs, pool, levels, second, monkeypatch):
    calls = []
    real = M.materialize
    monkeypatch.setattr(M, "materialize", lambda df: calls.append(1) or real(df))
    shape = lambda key: f"{key} string, value double, second double, tic int, sector int"
    rows = lambda xs, key: spark.createDataFrame([(x[key], x["value"], x["second"], x["tic"], x["sector"]) for x in xs], shape(key))
    a, b = rows(refs, "ref"), rows(pool, "cand")
    if not second:
        a, b = a.drop("second"), b.drop("second")
    got = M.match_without_replacement(a, b, levels, audit=not second, second=second).collect()
    assert len(got) == len(refs)
    return {r.ref: (r.cand, r.level, *((r.candidates, r.ties) if not second else ())) for r in got}, len(calls)


@pytest.mark.parametrize("second", [False, True])
def test_groups_first_gives_the_pairs_of_a_plain_loop(spark, second, monkeypatch):
    rnd = random.Random(11)
    row = lambda key, i: {key: f"O{i:04d}", "value": float(rnd.randint(0, 5)), "second": float(rnd.randint(0, 4)), "tic": rnd.randint(0, 4) or None, "sector": rnd.randint(0, 2)}
    refs, pool = [row("ref", i) for i in range(0, 40, 2)], [row("cand", i) for i in range(1, 38, 2)]
    want = plain(refs, pool, M.LEVELS, second)
    got, _ = run(spark, refs, pool, M.LEVELS, second, monkeypatch)
    assert got == (want if not second else {k: v[:2] for k, v in want.items()})
    assert any(v[1] == "UNMATCHED" for v in want.values()) and any(v[1] == "SAME_SECTOR" for v in want.values())


def test_equal_wishes_need_few_rounds(spark, monkeypatch):
    """Thirty references that want the same candidates elsewhere: each took a round of its own."""
    refs = [{"ref": f"R{i:03d}", "value": 5.0, "second": 0.0, "tic": i, "sector": 1} for i in range(30)]
    pool = [{"cand": f"C{i:03d}", "value": 5.0 + i // 3, "second": 0.0, "tic": 1000 + i, "sector": 1} for i in range(40)]
    got, calls = run(spark, refs, pool, M.LEVELS, False, monkeypatch)
    assert got == plain(refs, pool, M.LEVELS, False)
    assert calls < 60
