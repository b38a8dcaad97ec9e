"""Hard negatives against a plain search; the Hilbert curve and the bounds by themselves."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import negatives


def fine(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def plain(rows, every=10, k=5):
    """Rows are told apart by their place in the list."""
    own = [(n, i, lab, [int(np.floor(256 * float(np.float32(x)))) for x in v])
           for n, (i, lab, v) in enumerate(rows) if i is not None and lab is not None and fine(v)]
    out = []
    for n, i, lab, v in own:
        if i % every:
            continue
        near = sorted((-sum(a * b for a, b in zip(v, w)), j, m, lb) for m, j, lb, w in own if m != n and len(w) == len(v))
        for p, j, _, _ in [x for x in near if x[3] == lab][:k]:
            fits = [x for x in near if x[3] != lab and 80 * -p <= 100 * -x[0] <= 100 * -p][:k]
            out += [(i, j, r, x[1], -p, -x[0]) for r, x in enumerate(fits, 1)]
    return sorted(out)


def cases():
    rnd = np.random.default_rng(7)
    centre = rnd.normal(size=(6, 8))
    rows = [(i, int(i % 5), [float(x) for x in np.round(centre[i % 6] + 0.4 * rnd.normal(size=8), 2)]) for i in range(500)]
    rows += [(1_000 + i, 1 + i % 2, rows[0][2]) for i in range(150)]  # many copies of one vector under two labels
    rows += [(20, 0, rows[20][2]), (20, 0, rows[20][2]), (30, 3, rows[31][2]), (2_000, None, rows[1][2]), (None, 1, rows[1][2]), (2_010, 1, None),
             (2_020, 1, [None] * 8), (2_030, 1, [float("nan")] * 8), (2_040, 1, [float("-inf")] * 8), (2_050, 1, []), (2_060, 1, []), (2_061, 2, []),
             (2_070, 1, [1.0] * 9), (2_071, 1, [1.0] * 9), (2_072, 2, [0.9] * 9), (2_080, 99, rows[5][2]), (2_090, 7, [-5.0] * 20), (2_091, 7, [5.0] * 20)]
    return rows


SCHEMA = "vec_id bigint, label int, embedding array<float>"


@pytest.mark.parametrize("s", [negatives.Settings(), negatives.Settings(page=7, zone_pages=2, readers=3, key_dims=4),
                               negatives.Settings(page=16, zone_pages=1, map_bytes=2_000, readers=5)])
def test_mine(spark, s):
    rows = cases()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit("clash"), "zone": F.lit(1), "n": F.lit("x")}).repartition(3)
    got = sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 10 == 0, s).collect())
    want = plain(rows)
    assert got == want and len(want) > 500


def test_empty_and_lonely(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0
    one = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], SCHEMA)
    assert negatives.mine(one, F.col("vec_id") % 10 == 0).count() == 0


def test_large_numbers():
    big = np.asarray([[2.0**30, 2.0**30 + 1]])
    assert negatives.products(big, big)[0, 0] == 2**60 + (2**30 + 1) ** 2
    wide = np.asarray([[2.0**40, 2.0**40]]), np.asarray([[2.0**40, -(2.0**40)]])
    assert negatives.products(*wide)[0, 0] == 0
    with pytest.raises(OverflowError):
        negatives.products(wide[0], wide[0])


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (4, 2), (1, 5)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    cells = np.asarray(list(itertools.product(range(1 << bits), repeat=dims)))
    place = negatives.hilbert_index(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_bounds_hold_and_zones_are_passed_over():
    rnd = np.random.default_rng(3)
    groups = [np.floor(256 * (c + 0.05 * rnd.normal(size=(200, 6)))) for c in np.eye(6)]
    anchors = np.concatenate([g[:5] for g in groups])
    low, high = np.asarray([g.min(axis=0) for g in groups]), np.asarray([g.max(axis=0) for g in groups])
    least, greatest = negatives.bounds(anchors, low, high)
    for z, g in enumerate(groups):
        scores = anchors @ g.T
        assert (least[:, z] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= greatest[:, z]).all()
    zones = negatives.Zones([{"zone": z, "low": low[z], "high": high[z], "label_low": z, "label_high": z} for z in range(6)])
    windows = np.full((len(anchors), 1), 40_000)
    wanted = zones.wanted(anchors, np.full(len(anchors), 9), windows, np.full((len(anchors), 1), 90_000), same=False)
    assert wanted.sum() == len(anchors)  # each anchor reads the zone of its own direction only
