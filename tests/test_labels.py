"""Guards, labels, intervals and bounds on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from evenkeel.functions import labels as L
from evenkeel.functions import numeric as N
from evenkeel.functions import text as X
from evenkeel.operators import decisions as D
from evenkeel.operators import evaluation as E


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


@pytest.mark.parametrize("d01,d21,want", [
    (10.0, 11.0, False), (10.1, 10.1, True), (float("nan"), 50.0, None), (float("inf"), 50.0, None), (None, 50.0, None)])
def test_selection_is_strict_and_rejects_non_finite(spark, d01, d21, want):
    assert one(spark, L.selected(F.lit(d01).cast("double"), F.lit(d21))) is want


def test_strict_input_raises(spark):
    with pytest.raises(Exception, match="non-finite"):
        one(spark, L.selected(F.lit(float("nan")), F.lit(1.0), strict_input=True))


def test_wilson_anchor(spark):
    lo, hi = N.wilson(F.lit(143), F.lit(1800))
    assert round(one(spark, lo), 4) == 0.0678 and round(one(spark, hi), 4) == 0.0929


def test_wilson_on_empty(spark):
    for mode, check in (("null", lambda v: v is None), ("nan", math.isnan)):
        lo, _ = N.wilson(F.lit(0), F.lit(0), on_empty=mode)
        assert check(one(spark, lo))
    with pytest.raises(Exception, match="positive denominator"):
        one(spark, N.wilson(F.lit(0), F.lit(0), on_empty="raise")[0])


def test_wilson_clamp(spark):
    free, held = (N.wilson(F.lit(0), F.lit(10), clamp=c)[0] for c in (False, True))
    assert abs(one(spark, free)) < 1e-12 and one(spark, held) >= 0.0


def test_winner_tie_and_transitions(spark):
    s = lambda *v: {f"M{i}": F.lit(x) for i, x in enumerate(v)}
    assert one(spark, L.winner(s(1.0, 2.0, 3.0))) == "M0"
    assert one(spark, L.winner(s(1.0, 1.0 + 1e-13, 3.0))) == "TIE"
    t = lambda a, b: one(spark, L.transition(F.lit(a), F.lit(b)))
    assert [t(True, True), t(True, False), t(False, False), t(False, True)] == list(L.TRANSITIONS)


def test_comparability(spark):
    c = lambda a, b: one(spark, L.comparability(F.lit(a), F.lit(b)))
    assert c(L.INCOMPLETE, L.INADMISSIBLE) == L.INCOMPLETE
    assert c(L.INADMISSIBLE, "SELECTED") == "REFERENCE_INADMISSIBLE"
    assert c("SELECTED", "NOT_SELECTED") == "BOTH_ELIGIBLE"


def test_period_bins_edges(spark):
    b = lambda v: one(spark, N.period_bin(F.lit(v), E.PERIOD_EDGES, E.PERIOD_BINS))
    assert [b(39.9), b(40.0), b(63.245553203367585), b(300.0), b(300.1)] == [None, "P40_63", "P63_106", "P106_300", None]


def test_bound_hits(spark):
    got = one(spark, N.bound_hits([F.lit(10.0), F.lit(0.05 + 5e-8)], [(-10.0, 10.0), (0.05, None)]))
    assert [(h.parameter_index, h.side) for h in got] == [(0, "upper"), (1, "lower")]


def test_canonical_decimal_and_ids(spark):
    assert one(spark, N.canonical_decimal(F.lit("2198.799700"))) == "2198.7997"
    assert one(spark, N.canonical_decimal(F.lit("100"))) == "100"
    assert one(spark, X.doi(F.lit("https://doi.org/10.1/ABC. "))) == "10.1/abc"
    assert one(spark, X.arxiv_id(F.lit("arXiv:2101.00001v3"))) == "2101.00001"
    assert one(spark, X.title(F.lit("  Été—QPP  in X-rays "))) == "ete qpp in x rays"
    assert one(spark, X.version_key(F.lit("5.0.12"))) == [5, 0, 12, 0, 0, 0, 0, 0]
    assert one(spark, X.id_list(F.lit("A1;NONE;;B2"))) == ["A1", "B2"]


def test_trio_modes(spark):
    rows = [("k1", "M0", 30.0), ("k1", "M1", 5.0), ("k1", "M2", 20.0), ("k2", "M0", 1.0)]
    df = spark.createDataFrame(rows, "k string, model string, score double")
    got = D.assemble_trios(df, ["k"], mode="skip").collect()
    assert [(r.k, r.d01, r.d21, r.selected) for r in got] == [("k1", 25.0, 15.0, True)]
    with pytest.raises(Exception, match="incomplete or repeated trio"):
        D.assemble_trios(df, ["k"], mode="error").collect()


def test_trio_with_nan_is_incomplete(spark):
    rows = [("k", "M0", 30.0), ("k", "M1", float("nan")), ("k", "M2", 20.0)]
    r = D.assemble_trios(spark.createDataFrame(rows, "k string, model string, score double"), ["k"]).first()
    assert r.decision_status == L.INCOMPLETE and r.selected is None


def test_confusion_anchor(spark):
    rows = [(True, True)] * 143 + [(True, False)] * 1657 + [(False, False)] * 1799 + [(False, True)]
    conf = E.confusion(spark.createDataFrame(rows, "truth boolean, selected boolean"))
    assert tuple(conf.first()) == (143, 1657, 1799, 1)
    got = {r.metric: r for r in E.rates(conf).collect()}
    assert round(got["sensitivity"].rate, 4) == 0.0794 and got["specificity"].numerator == 1799
