"""Data checks. Every check returns a frame of violations; raising is the caller's choice."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.numeric import is_finite


def _key_text(keys: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])


def violations(df: DataFrame, rule: str, keys: Sequence[str], detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), _key_text(keys).alias("key"), detail.cast("string").alias("detail"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique_key(df: DataFrame, keys: Sequence[str], rule: str = "unique_key") -> DataFrame:
    return violations(duplicate_keys(df, keys), rule, keys, F.col("n"))


def foreign_key(child: DataFrame, parent: DataFrame, keys: Sequence[str], parent_keys: Sequence[str] | None = None,
                rule: str = "foreign_key") -> DataFrame:
    """Child keys without a parent row, one violation per key with its child row count.

    Child keys are counted first, so a key that a third of the rows share is one row in the join.
    """
    parent_keys = parent_keys or keys
    counted = child.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    heads = parent.select(*[F.col(p).alias(k) for p, k in zip(parent_keys, keys)]).distinct()
    return violations(counted.join(heads, list(keys), "left_anti"), rule, keys, F.col("n"))


def expected_rows(df: DataFrame, n: int, rule: str = "row_count") -> DataFrame:
    got = df.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != n)
    return got.select(F.lit(rule).alias("rule"), F.lit("").alias("key"), F.col("n").cast("string").alias("detail"))


def group_topology(df: DataFrame, keys: Sequence[str], n: int, rule: str = "group_rows") -> DataFrame:
    """Groups whose row count is not ``n``."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return violations(sizes.where(F.col("n") != n), rule, keys, F.col("n"))


def domain(df: DataFrame, column: str, allowed: Sequence[str], rule: str = "domain") -> DataFrame:
    """Values outside the allowed list, with their row count."""
    bad = df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))
    return violations(bad.groupBy(column).agg(F.count(F.lit(1)).alias("n")), rule, [column], F.col("n"))


def exactly_one(df: DataFrame, keys: Sequence[str], flag: Column, rule: str = "exactly_one") -> DataFrame:
    """Groups in which ``flag`` does not hold exactly once."""
    sizes = df.groupBy(*keys).agg(F.count_if(flag).alias("n"))
    return violations(sizes.where("n <> 1"), rule, keys, F.col("n"))


def row_text(columns: Sequence[str]) -> Column:
    """Canonical text of a row: every value as text, fields in the given order, NULL marked."""
    return F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])


def row_fingerprint(df: DataFrame, columns: Sequence[str] | None = None, name: str = "fingerprint") -> DataFrame:
    return df.withColumn(name, F.sha2(row_text(sorted(columns or df.columns)), 256))


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free content fingerprint: row count and the sum of 52-bit row hashes."""
    part = F.conv(F.substring(F.sha2(row_text(sorted(columns or df.columns)), 256), 1, 13), 16, 10)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(part.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("content_sum"),
    )


def finite(df: DataFrame, columns: Sequence[str], keys: Sequence[str], rule: str = "finite") -> DataFrame:
    """One violation per row and column that is NULL, NaN or infinite."""
    bad = F.array_compact(F.array(*[F.when(~is_finite(F.col(c).cast("double")), F.lit(c)) for c in columns]))
    hit = df.withColumn("_bad", F.explode(bad))
    return violations(hit, rule, keys, F.col("_bad"))


def leakage(df: DataFrame, unit: str, split: str, rule: str = "split_leakage") -> DataFrame:
    """Units that occur in more than one split."""
    spread = df.groupBy(unit).agg(F.min(split).alias("_a"), F.max(split).alias("_b")).where("_a <> _b")
    return violations(spread, rule, [unit], F.concat_ws("|", "_a", "_b"))


def contiguous_ranks(df: DataFrame, keys: Sequence[str], rank: str, rule: str = "contiguous_ranks") -> DataFrame:
    """Groups whose ranks are not exactly 1..n.

    ``n`` ranks with minimum 1, maximum ``n`` and as many distinct values as rows.
    """
    s = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("lo"), F.max(rank).alias("hi"),
                              F.countDistinct(rank).alias("d"))
    bad = s.where((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("d") != F.col("n")))
    return violations(bad, rule, keys, F.concat_ws("|", "n", "lo", "hi", "d"))


def temporal_order(df: DataFrame, keys: Sequence[str], times: Sequence[str], rule: str = "temporal_order") -> DataFrame:
    """Rows whose times are not in ascending order."""
    ok = reduce(lambda a, b: a & b, [F.col(x) <= F.col(y) for x, y in zip(times, times[1:])])
    return violations(df.where(~F.coalesce(ok, F.lit(False))), rule, keys, F.concat_ws("|", *times))
