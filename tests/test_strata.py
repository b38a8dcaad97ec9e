"""Strata that the design does not declare."""

from evenkeel.operators import evaluation


def test_undeclared_strata_are_violations(spark):
    rows = [("en", "a", True, True, True, "P1"), ("xx", "a", True, True, False, "P1"), (None, "a", False, True, False, None),
            ("en", "a", True, False, None, None), ("en", "a", False, True, True, None)]
    df = spark.createDataFrame(rows, "lang string, grp string, truth boolean, eligible boolean, selected boolean, bin string")
    grid = spark.createDataFrame([("POSITIVE", "en", "a", "ALL"), ("POSITIVE_BY_PERIOD", "en", "a", "P1"), ("NULL_POOLED", "en", "ALL", "ALL")],
                                 "kind string, lang string, grp string, bin string")
    got = {(r.key, r.detail) for r in evaluation.undeclared_strata(df, grid, ["lang", "grp"], ["lang"], "bin").collect()}
    assert got == {("POSITIVE|xx|a|ALL", "1 rows"), ("POSITIVE_BY_PERIOD|xx|a|P1", "1 rows"), ("NULL_POOLED|NULL|ALL|ALL", "1 rows"),
                   ("POSITIVE_BY_PERIOD|en|a|NONE", "1 rows")}
