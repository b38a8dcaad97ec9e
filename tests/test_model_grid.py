"""Grid fits of series in one placement and in blocks, against a plain search."""

import itertools
import math

import numpy as np
import pytest

from evenkeel.operators import spectra as S

POINTS = {"M0": (4, 3, 3), "M1": (2, 2, 2, 3, 3, 2), "M2": (3, 2, 3, 2, 2)}


def value(model, a, f, fmin):
    if model == "M2":
        low = math.exp(a[0]) * f ** -a[1] if f < a[2] else math.exp(a[0]) * a[2] ** (-a[1] + a[3]) * f ** -a[3]
        return low + math.exp(a[4])
    base = math.exp(a[0]) * (f / fmin) ** -a[1] + math.exp(a[2])
    if model == "M1":
        base += math.exp(a[3]) / math.sqrt(2 * math.pi * a[5] ** 2) * math.exp(-0.5 * ((math.log(f) - a[4]) / a[5]) ** 2)
    return base


def plain(rows):
    out = {}
    for s in {r[0] for r in rows}:
        own = [(f, p) for x, f, p in rows if x == s]
        fmin = min(f for f, _ in own)
        for model, pts in POINTS.items():
            lnl = [-sum(math.log(value(model, a, f, fmin)) + p / value(model, a, f, fmin) for f, p in own) for a in itertools.product(*S.axes(model, pts))]
            top = max(lnl)
            out[s, model] = (round(top, 4), sum(round(x, 6) == round(top, 6) for x in lnl))
    return out


def table():
    rnd = np.random.default_rng(12)
    freq = {1: np.linspace(0.001, 0.02, 150), 2: np.linspace(0.002, 0.02, 40), 3: np.linspace(0.01, 0.02, 3)}
    return [(s, float(f), float((f / 0.001) ** -1.5 * rnd.exponential() + 1e-3)) for s, fs in freq.items() for f in fs]


@pytest.mark.parametrize("block", [4_096, 7, 1])
def test_best_point_is_exact(spark, block):
    rows = table()
    df = spark.createDataFrame(rows, "s int, freq double, power double")
    got = {(r.s, r.model): (round(r.lnl, 4), r.ties) for r in S.fit_grid(df, ["s"], POINTS, refine=0, block=block).collect()}
    assert got == plain(rows)


def test_refined_points_agree_between_placements(spark):
    df = spark.createDataFrame(table(), "s int, freq double, power double")
    fits = [{(r.s, r.model): tuple(round(x, 5) for x in (r.lnl, r.a0, r.a1, r.a2, r.a3, r.a4, r.a5)) + (r.ties, r.bins)
             for r in S.fit_grid(df, ["s"], POINTS, refine=2, block=b).collect()} for b in (4_096, 9)]
    assert fits[0] == fits[1] and len(fits[0]) == 9


def test_blocks_drop_points_and_keep_the_best(spark):
    """A power of zero has no lower bound: nothing may be dropped then."""
    rows = [*table(), (1, 0.0205, 0.0), (4, 0.01, 0.0), (4, 0.02, 1.0)]
    df = spark.createDataFrame(rows, "s int, freq double, power double")
    got = {(r.s, r.model): (round(r.lnl, 4), r.ties) for r in S.fit_grid(df, ["s"], POINTS, refine=0, block=10).collect()}
    assert got == plain(rows)


def test_warnings(spark):
    df = spark.createDataFrame(table(), "s int, freq double, power double")
    fits = S.fit_status(S.fit_grid(df, ["s"], POINTS, refine=1)).collect()
    assert all(r.warning_count == (r.ties > 1) for r in fits) and any(r.ties > 1 for r in fits)
    assert all(("TieOfBestPoints: " in r.warning_types) == (r.ties > 1) for r in fits)
    far = spark.createDataFrame([(1, 1e-300, 1.0), (1, 1.0, 1.0)], "s int, freq double, power double")
    got = {r.model: r for r in S.fit_status(S.fit_grid(far, ["s"], POINTS, refine=0)).collect()}
    assert "Overflow" in got["M2"].warning_types and got["M0"].overflow == 0


def test_lattice_equals_rows():
    freq = np.linspace(0.001, 0.02, 9)
    for m, lattice in S._lattices(POINTS).items():
        theta = np.array([[*x, *[0.0] * (S.WIDTH - len(x))] for x in itertools.product(*lattice)])
        got = S.lattice_power(m, lattice, freq, freq[0]).reshape(len(theta), -1)
        assert np.allclose(got, S.model_power(m, theta, freq, freq[0]), rtol=1e-12)
        model = S.MODELS[m]
        assert np.allclose(got, [[value(model, a, f, freq[0]) for f in freq] for a in theta], rtol=1e-9)


def test_short_series_are_dealt_once(spark):
    """Points of the grid and of its refinements stay in the task of their series."""
    df = spark.createDataFrame(table(), "s int, freq double, power double")
    plan = S.fit_grid(df, ["s"], POINTS, refine=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
