"""Numeric column expressions: finite guards, intervals, times, errors and bounds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType

# The two-sided 95 % normal quantile, the selection threshold on both score
# differences, one 20 s cadence in days, the comparison tolerance, and the Julian day of
# the Unix epoch less the day origin of the relative scale.
Z_95 = 1.959963984540054
THRESHOLD = 10.0
CADENCE_DAYS = 20.0 / 86400.0
TOLERANCE = 5.0e-12
BOUND_TOLERANCE = 1.0e-7
UNIX_EPOCH_RELATIVE_DAY = 2440587.5 - 2457000.0


def is_finite(x: Column) -> Column:
    """True for an ordinary number; false for NULL, NaN and both infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def finite_or_null(x: Column) -> Column:
    return F.when(is_finite(x), x)


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double, NULL when the denominator is zero."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def wilson(k: Column, n: Column, clamp: bool = True, on_empty: str = "null", z: float = Z_95) -> tuple[Column, Column]:
    """Wilson score bounds for ``k`` of ``n``.

    ``on_empty`` says what an empty denominator gives: ``null``, ``nan`` or ``raise``.
    """
    n = n.cast("double")
    p = k.cast("double") / n
    z2 = z * z
    den = 1.0 + F.lit(z2) / n
    center = (p + F.lit(z2) / (2.0 * n)) / den
    half = F.lit(z) * F.sqrt(p * (1.0 - p) / n + F.lit(z2) / (4.0 * n * n)) / den
    lo, hi = center - half, center + half
    if clamp:
        lo, hi = F.greatest(F.lit(0.0), lo), F.least(F.lit(1.0), hi)
    empty = {
        "null": F.lit(None).cast("double"),
        "nan": F.lit(float("nan")),
        "raise": F.raise_error(F.lit("a Wilson interval needs a positive denominator")).cast("double"),
    }[on_empty]
    return F.when(n > 0, lo).otherwise(empty), F.when(n > 0, hi).otherwise(empty)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the session zone."""
    seconds = (ts.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("interval second")
    return (seconds.cast("decimal(20,6)") * 1_000_000).cast("bigint")


def relative_day(ts: Column) -> Column:
    """Calendar time as days on the relative Julian scale."""
    return epoch_micros(ts).cast("double") / F.lit(86_400_000_000.0) + F.lit(UNIX_EPOCH_RELATIVE_DAY)


def canonical_decimal(x: Column, scale: int = 9) -> Column:
    """Plain decimal text without trailing zeros, for use as a join key."""
    text = x.cast(f"decimal(28,{scale})").cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def number_text(x: Column) -> Column:
    """One text for each number, so that equal numbers have equal texts: whole numbers without point, no negative zero."""
    d = x.cast("double")
    whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
    return F.when(whole, F.floor(d).cast("bigint").cast("string")).otherwise(d.cast("string"))


def payload_text(params: Column, kind: DataType) -> Column:
    """Canonical text of an array of numbers, or of a map from names to numbers with the names in order.

    ``kind`` is the column's type. A null payload is ``null``, a null number in it too.
    """
    told = lambda x: F.coalesce(number_text(x), F.lit("null"))
    if isinstance(kind, MapType):
        pairs = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(F.to_json(F.struct(e["key"].alias("k"))), told(e["value"])))
        text = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    else:
        text = F.concat(F.lit("["), F.array_join(F.transform(params, told), ","), F.lit("]"))
    return F.coalesce(text, F.lit("null"))


def log_duration(start: Column, end: Column, floor: float = CADENCE_DAYS) -> Column:
    """Log of the duration, floored at one sample."""
    return F.log(F.greatest(end - start, F.lit(floor)))


def ordered_times(start: Column, peak: Column, end: Column) -> Column:
    return (start <= peak) & (peak <= end)


def period_errors(estimate: Column, truth: Column) -> dict[str, Column]:
    """Signed, absolute, relative, percent error and log ratio; NULL unless both are positive."""
    ok = is_finite(estimate) & is_finite(truth) & (estimate > 0) & (truth > 0)
    diff = estimate - truth
    return {
        "signed_error": F.when(ok, diff),
        "absolute_error": F.when(ok, F.abs(diff)),
        "relative_error": F.when(ok, F.abs(diff) / truth),
        "relative_error_percent": F.when(ok, F.lit(100.0) * F.abs(diff) / truth),
        "log_ratio": F.when(ok, F.log(estimate / truth)),
    }


def bound_hits(params: Sequence[Column], bounds: Sequence[tuple[float | None, float | None]],
               atol: float = BOUND_TOLERANCE) -> Column:
    """Array of (parameter_index, side, value, bound) for parameters that sit on a bound."""
    if len(params) != len(bounds):
        raise ValueError("parameter and bound counts differ")
    sides = []
    for i, (p, (lo, hi)) in enumerate(zip(params, bounds)):
        for side, edge in (("lower", lo), ("upper", hi)):
            if edge is not None:
                hit = F.struct(F.lit(i).alias("parameter_index"), F.lit(side).alias("side"),
                               p.alias("value"), F.lit(float(edge)).alias("bound"))
                sides.append(F.when(F.abs(p - F.lit(float(edge))) <= atol, hit))
    return F.array_compact(F.array(*sides))


def period_from_log_frequency(p: Column) -> Column:
    return F.lit(1.0) / F.exp(p)


def period_bin(x: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """Bin label; every bin holds its lower edge, only the last holds its upper edge."""
    if len(edges) != len(names) + 1:
        raise ValueError("need one more edge than names")
    out = None
    for i, name in enumerate(names):
        top = x <= edges[i + 1] if i == len(names) - 1 else x < edges[i + 1]
        hit = (x >= edges[i]) & top
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def hash_uniform(*parts: Column) -> Column:
    """Deterministic uniform number in [0, 1) from the first 52 bits of a SHA-256."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def hash_index(n: Column, *parts: Column) -> Column:
    """Deterministic index in [0, n) from the first 52 bits of a SHA-256."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint"), n.cast("bigint"))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
