"""Deterministic samples and splits of a plan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.ordered import number_rows
from evenkeel.operators.summaries import attach


def hash_split(df: DataFrame, unit: str, strata: Sequence[str], salt: str,
               names: tuple[str, str] = ("DEVELOPMENT", "HELDOUT"), group_rows: int | None = None) -> DataFrame:
    """Rank units by SHA-256 within their stratum; the first half is ``names[0]``, the rest ``names[1]``."""
    units = df.select(*strata, unit).distinct().withColumn(
        "_h", F.sha2(F.concat(F.lit(f"{salt}:"), F.col(unit).cast("string")), 256))
    ranked = number_rows(units, strata, [F.col("_h"), F.col(unit)], "hash_rank", group_rows)
    sizes = units.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    out = attach(ranked, sizes, strata)
    first = F.col("hash_rank") * 2 <= F.col("_n")
    return out.withColumn("split", F.when(first, names[0]).otherwise(names[1])).drop("_h", "_n")


def coverage_sample(df: DataFrame, by: Sequence[str], wanted: Sequence[tuple], wanted_by: Sequence[str],
                    order: Sequence[str]) -> DataFrame:
    """First row in ``order`` per group, for each wanted combination only."""
    hit = F.lit(False)
    for combo in wanted:
        hit = hit | reduce(lambda a, b: a & b, [F.col(c).cast("string").eqNullSafe(F.lit(str(v))) for c, v in zip(wanted_by, combo, strict=True)])
    return first_rows(df.where(hit), by, [F.col(c) for c in order])


def coverage_gaps(df: DataFrame, wanted: Sequence[tuple], wanted_by: Sequence[str]) -> DataFrame:
    """Violations ``(rule, key, detail)`` for wanted combinations that no row has."""
    names = [f"_{i}" for i in range(len(wanted_by))]
    asked = df.sparkSession.createDataFrame([tuple(map(str, c)) for c in wanted], ", ".join(f"{n} string" for n in names))
    there = df.select(*[F.col(c).cast("string").alias(n) for c, n in zip(wanted_by, names, strict=True)]).distinct()
    return asked.join(there, names, "left_anti").select(
        F.lit("coverage").alias("rule"), F.concat_ws("|", *names).alias("key"), F.lit("no row").alias("detail"))


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per group in a total order, as a map-side aggregation."""
    rest = [c for c in df.columns if c not in by]
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), key).alias("_r")).select(*by, "_r.*")


def extremes_sample(df: DataFrame, by: Sequence[str], size: str, ident: str, chosen: DataFrame) -> DataFrame:
    """Shortest, then longest row per group outside ``chosen``; ties go to the smallest id."""
    left = df.join(chosen.select(ident).distinct(), ident, "left_anti")
    short = first_rows(left, by, [F.col(size), F.col(ident)]).withColumn("component", F.lit("SHORTEST"))
    left = left.join(short.select(ident), ident, "left_anti")
    long = first_rows(left, by, [-F.col(size), F.col(ident)]).withColumn("component", F.lit("LONGEST"))
    return short.unionByName(long)


def anchor_sample(anchors: DataFrame, everything: DataFrame, key: str, seeds: Sequence[int], seed: str = "seed") -> DataFrame:
    """Rows of the anchors' key at the declared seeds."""
    return everything.where(F.col(seed).isin(*seeds)).join(anchors.select(key).distinct(), key, "left_semi")


def sequential_extremes(df: DataFrame, ident: str, passes: Sequence[tuple[str, Column, Sequence[Column]]]) -> DataFrame:
    """One row per pass from what earlier passes left: (name, filter, order).

    Every pass is a top-1, so what is excluded from the next one is a single row.
    """
    picked = None
    for name, keep, order in passes:
        left = df.where(keep)
        if picked is not None:
            left = left.join(F.broadcast(picked.select(ident)), ident, "left_anti")
        top = left.orderBy(*order).limit(1).withColumn("pass", F.lit(name))
        picked = top if picked is None else picked.unionByName(top)
    return picked
