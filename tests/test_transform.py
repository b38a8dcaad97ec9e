"""Transforms in one piece, in two steps and by a chirp, against the direct sum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import spectra
from evenkeel.operators.transform import dft

LENGTHS = (1, 2, 7, 12, 36, 97, 360, 509, 1_024, 1_009)


def table(spark):
    rnd = np.random.default_rng(6)
    values = {(n, tag): rnd.normal(size=n) for n in LENGTHS for tag in ("a", None)}
    rows = [(n, tag, j, float(x), n, n - 1) for (n, tag), v in values.items() for j, x in enumerate(v)]
    return values, spark.createDataFrame(rows, "s int, tag string, j int, x double, n int, top int").repartition(5)


@pytest.mark.parametrize("piece, lopsided", [(1 << 16, 64), (16, 1e9), (16, 2.0), (1, 1.0)])
def test_equal_to_direct_sum(spark, piece, lopsided):
    values, df = table(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = dft(df, ["s", "tag"], "x", "j", "n", "top", piece=piece, lopsided=lopsided).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = {key: np.full(len(v), np.nan, complex) for key, v in values.items()}
    for r in got:
        assert np.isnan(out[r.s, r.tag][r.k])
        out[r.s, r.tag][r.k] = r.re + 1j * r.im
    for (n, tag), v in values.items():
        k = np.arange(n)
        want = (v[None, :] * np.exp(-2j * np.pi * (k[:, None] * k[None, :] % n) / n)).sum(axis=1)
        assert np.allclose(out[n, tag], want, atol=1e-9 * max(1, n)), (n, tag)


def test_rows_of_a_split_series(spark):
    """A long series has n rows in each step, and no task gets more than a piece."""
    n = 4_096
    df = spark.range(n).select(F.lit(1).alias("s"), F.col("id").alias("j"), F.sin(F.col("id") * 0.3).alias("x"), F.lit(n).alias("n"), F.lit(n - 1).alias("top"))
    got = dft(df, ["s"], "x", "j", "n", "top", piece=64)
    assert got.count() == n and got.select("k").distinct().count() == n
    loudest = got.withColumn("p", F.hypot("re", "im")).orderBy(F.desc("p")).first().k
    assert min(loudest, n - loudest) == round(0.3 * n / (2 * np.pi))


def test_power_of_long_series_equals_that_of_short_pieces(spark, monkeypatch):
    rnd = np.random.default_rng(8)
    rows = [(s, j, 20.0 * j, float(100 + x)) for s, n in ((1, 211), (2, 240)) for j, x in enumerate(rnd.normal(size=n))]
    df = spark.createDataFrame(rows, "s int, pos long, t double, y double")
    whole = {(r.s, r.k): r.power for r in spectra.power_spectrum(df, ["s"]).collect()}
    monkeypatch.setattr(spectra, "dft", lambda *a, **k: dft(*a, **k, piece=16, lopsided=2.0))
    split = {(r.s, r.k): r.power for r in spectra.power_spectrum(df, ["s"]).collect()}
    assert whole.keys() == split.keys() and len(whole) == 105 + 119
    assert all(abs(whole[key] - split[key]) < 1e-9 for key in whole)


def test_empty(spark):
    _, df = table(spark)
    assert dft(df.limit(0), ["s", "tag"], "x", "j", "n", "top").count() == 0
