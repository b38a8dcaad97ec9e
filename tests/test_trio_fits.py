"""Fits of complete trios, from rows of their own."""

from evenkeel.suite.decisions import trio_fits
from evenkeel.suite.registry import Tables

ROWS = [(1, 1, "R"), (1, 1, "A"), (1, 1, "N"), (1, 1, "N"), (1, 2, "R"), (1, 2, "A"), (2, 1, "R"), (2, 1, "A"), (2, 1, "N"), (2, 1, None),
        (None, 1, "R"), (None, 1, "A"), (None, 1, "N"), (3, 4, "N"), (3, 4, "R"), (3, 4, "A")]


def test_fits_of_trios_are_not_joined_back(spark, tmp_path):
    rows = [(p, 7 * i, line, 1.0 * i, 10.0, 0.1 if i % 2 else 0.0, 0.0 if i % 3 else 0.02, flag) for i, (p, line, flag) in enumerate(ROWS)]
    spark.createDataFrame(rows, "l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                                "l_tax double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    whole, fits = trio_fits(Tables(spark, str(tmp_path)))
    assert "Join" not in fits._jdf.queryExecution().executedPlan().toString()
    assert sorted((str(r.series_id), r.seed) for r in whole.collect()) == [("1", 0), ("3", 3), ("None", 0)]
    got = sorted((r.series_id, r.seed, r.model, r.warnings, r.bound_hits, r.status, tuple(r.parameters)) for r in fits.collect())
    name = {"R": "M0", "A": "M1", "N": "M2"}
    want = []
    for part, line in ((1, 1), (3, 4)):
        for flag in "RAN":
            own = [r for r in rows if (r[0], r[2], r[7]) == (part, line, flag)]
            free = sum(r[6] == 0 for r in own)
            want.append((part, line - 1, name[flag], free, sum(r[5] == 0.1 for r in own), "ERROR" if max(r[1] for r in own) % 50 == 7 else "OK",
                         (max(r[5] for r in own) * 100.0 / 8.0, max(r[6] for r in own), float(free))))
    assert got == sorted(want)
