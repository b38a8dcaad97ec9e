"""Plain and split-group paths give the same rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import ordered as O


def rows(n=120, seed=1):
    rnd = random.Random(seed)
    groups = ["hot"] * 8 + ["a", "b", None]
    return [(i, rnd.choice(groups), float(rnd.randint(0, 20)), rnd.choice([None, 1.0, 2.5])) for i in range(n)]


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(rows(), "id bigint, g string, x double, v double")


def both(spark, build):
    plain = sorted(map(str, build().collect()))
    spark.conf.set("evenkeel.group.rows", "3")
    try:
        split = sorted(map(str, build().collect()))
    finally:
        spark.conf.unset("evenkeel.group.rows")
    return plain, split


@pytest.mark.parametrize("by", [["g"], []])
def test_paths_agree(spark, frame, by):
    order = [F.col("x"), F.col("id")]
    for build in (
        lambda: O.number_rows(frame, by, order, "n"),
        lambda: O.running_sum(frame, by, order, {"s": F.col("id"), "c": F.lit(1), "sv": F.col("v")}),
        lambda: O.running_sum(frame, by, [F.col("id").desc()], {"sv": F.col("v")}),
        lambda: O.running_sum(frame.limit(0), by, order, {"sv": F.col("v")}),
        lambda: O.neighbours(frame, by, order, prev={"p": F.col("v"), "pi": F.col("id")}, next={"ni": F.col("id")}),
        lambda: O.neighbours(frame, by, order, prev={"pi": F.col("id")}, among=F.col("v").isNotNull()),
        lambda: O.neighbours(frame, by, order, prev={"p": F.col("v")}, among=F.col("x") > 5),
        lambda: O.carry(frame, by, order, back={"b": F.col("v")}, ahead={"a": F.col("v")}),
    ):
        plain, split = both(spark, build)
        assert plain == split


def test_quantiles_match_numpy(spark, frame, split_groups):
    probs = (0.0, 0.16, 0.25, 0.5, 0.9, 1.0)
    got = {r.g: r.q for r in O.quantiles(frame, ["g"], {"q": F.col("x")}, probs).collect()}
    for g in ("hot", "a", "b", None):
        vals = [r[2] for r in rows() if r[1] == g]
        assert np.allclose(got[g], np.quantile(vals, probs))


def test_quantile_anchor_and_non_finite(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 10.0, 20.0, 30.0, float("nan"), float("inf"), None)], "x double")
    assert O.quantiles(df, [], {"q": F.col("x")}, (0.25,)).first().q == [7.5]


def test_empty_quantile_group_is_null(spark, split_groups):
    df = spark.createDataFrame([("a", None)] * 5 + [("b", 1.0)] * 5, "g string, x double")
    got = {r.g: r.q for r in O.quantiles(df, ["g"], {"q": F.col("x")}, (0.5,)).collect()}
    assert got == {"a": None, "b": [1.0]}


def test_among_refuses_next_on_both_paths(spark, frame):
    def run():
        with pytest.raises(ValueError):
            O.neighbours(frame, ["g"], [F.col("id")], next={"n": F.col("id")}, among=F.col("v").isNotNull())
        return frame.limit(0)
    both(spark, run)


def test_markers_without_finite_time_have_no_sample(spark):
    from evenkeel.operators import joins as J
    markers = spark.createDataFrame([(1, None), (2, float("nan")), (3, float("inf")), (4, 1.2)], "m int, t double").withColumn("g", F.lit("a"))
    samples = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 1.0), ("a", 2, float("nan"))], "g string, idx long, t double")
    got = {r.m: (r.idx, r.residual) for r in J.nearest_join(markers, samples, ["g"]).collect()}
    assert got[4][0] == 1 and {got[m] for m in (1, 2, 3)} == {(None, None)}


def test_containment_with_one_very_long_interval(spark):
    from evenkeel.operators import joins as J
    rnd = random.Random(9)
    spans = [(f"i{k}", 10.0 * k, 10.0 * k + rnd.random()) for k in range(200)] + [("long", -5e5, 5e5), ("point", 77.0, 77.0), ("bad", 5.0, 4.0)]
    times = [(i, t) for i, t in enumerate([rnd.uniform(-50, 2100) for _ in range(300)] + [77.0, 10.0, 1e9, float("nan"), None])]
    got = J.containment_join(spark.createDataFrame(times, "e int, t double"), spark.createDataFrame(spans, "name string, s double, f double"),
                             ["e"], "t", "s", "f", "name")
    want = {}
    for i, t in times:
        hit = [n for n, a, b in spans if t is not None and a <= t <= b]
        want[i] = (len(hit), hit[0] if len(hit) == 1 else None)
    assert {r.e: (r.matches, r.name) for r in got.collect()} == want


@pytest.mark.parametrize("limit, small", [("3", 0), ("1000000", 0), ("1000000", 4_096)])
def test_partition_join_on_all_paths(spark, limit, small):
    from evenkeel.operators import joins as J
    bounds = [(0.0, "a"), (10.0, "b"), (10.5, "c"), (1e7, "d")]
    times = [(i, t) for i, t in enumerate([-1.0, 0.0, 9.9, 10.0, 10.4, 11.0, 9e6, 1e7, 2e7, float("nan"), None])]
    spark.conf.set("evenkeel.group.rows", limit)
    try:
        got = {r.e: r.part for r in J.partition_join(spark.createDataFrame(times, "e int, t double"),
                                                     spark.createDataFrame(bounds, "lo double, part string"), "t", "lo", "part", small=small).collect()}
    finally:
        spark.conf.unset("evenkeel.group.rows")
    assert got == dict(enumerate([None, "a", "a", "b", "b", "c", "c", None, None, None, None]))


def test_partition_join_by_bisection(spark):
    """Every place around every boundary, repeated boundaries, one or no boundary; the events are not shuffled."""
    from evenkeel.operators import joins as J
    lows = [float(x * x) for x in range(50)]
    bounds = spark.createDataFrame([(x, i) for i, x in enumerate(lows)] + [(4.0, 99)], "lo double, part int")
    events = spark.createDataFrame([(x + d,) for x in lows for d in (-0.5, 0.0, 0.25)], "t double")
    out = J.partition_join(events, bounds, "t", "lo", "part")
    for r in out.collect():
        at = max((i for i, x in enumerate(lows) if x <= r.t), default=-1)
        want = None if at in (-1, 49) else (99 if lows[at] == 4.0 else at)
        assert r.part == want and (want is None or r.margin == min(r.t - lows[at], lows[at + 1] - r.t))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    for n in (0, 1):
        assert {(r.part, r.margin) for r in J.partition_join(events, bounds.limit(n), "t", "lo", "part").collect()} == {(None, None)}
