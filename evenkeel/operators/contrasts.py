"""Paired contrasts: between design conditions, windows, profiles, pair members and products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions import labels as L
from evenkeel.functions.numeric import safe_ratio
from evenkeel.operators.ordered import grouped
from evenkeel.operators.summaries import attach


def _sides(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    left = df.select(*keys, *[F.col(v).alias(f"l_{v}") for v in values])
    right = df.select(*keys, *[F.col(v).alias(f"r_{v}") for v in values])
    return left, right


def design_pairs(design: DataFrame, same: Sequence[str], step: str, condition: str = "condition") -> DataFrame:
    """All ordered pairs of conditions that agree on ``same`` and rise in ``step``.

    The design table lists conditions, not rows of data: it has one row per condition.
    """
    left, right = _sides(design, same, [condition, step])
    return left.join(right, list(same)).where(F.col(f"l_{step}") < F.col(f"r_{step}"))


def paired_contrast(pairs: DataFrame, rows: DataFrame, unit: str, value: str, condition: str = "condition",
                    keep: Sequence[str] = ()) -> DataFrame:
    """2x2 selection contingency and median paired change over shared units of two conditions.

    ``pairs(l_condition, r_condition)`` and ``rows(condition, unit, selected, value)``. Rows meet
    on ``(condition, unit)``, so a popular condition is spread over its units.
    """
    left, right = _sides(rows.select(condition, unit, "selected", value), [unit], [condition, "selected", value])
    joined = pairs.join(left, f"l_{condition}").join(right, [f"r_{condition}", unit])
    by = [f"l_{condition}", f"r_{condition}", *keep]
    l, r = F.col("l_selected"), F.col("r_selected")
    counts = [F.count(F.lit(1)).alias("n_pairs"),
              F.count_if(~l & ~r).alias("n00"), F.count_if(~l & r).alias("n01"),
              F.count_if(l & ~r).alias("n10"), F.count_if(l & r).alias("n11")]
    out = grouped(joined, by, counts, {"_m": F.col(f"r_{value}") - F.col(f"l_{value}")}, (0.5,))
    out = out.withColumn("median_change", F.try_element_at("_m", F.lit(1))).drop("_m")
    n = F.col("n_pairs")
    lr, rr = safe_ratio(F.col("n10") + F.col("n11"), n), safe_ratio(F.col("n01") + F.col("n11"), n)
    return out.withColumns({"left_rate": lr, "right_rate": rr, "rate_difference": rr - lr})


def pairing_integrity(pairs: DataFrame, rows: DataFrame, unit: str, fields: Sequence[str],
                      condition: str = "condition") -> DataFrame:
    """Per condition pair: shared units, and how many disagree on any of ``fields``."""
    left, right = _sides(rows.select(condition, unit, *fields), [unit], [condition, *fields])
    joined = pairs.join(left, f"l_{condition}").join(right, [f"r_{condition}", unit])
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}"))
    return joined.groupBy(f"l_{condition}", f"r_{condition}").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(~same).alias("n_mismatched"))


def step_contrast(pairs: DataFrame, rows: DataFrame, unit: str, condition: str = "condition",
                  threshold: float = 10.0) -> DataFrame:
    """Threshold crossings, winner changes and median changes between two conditions.

    ``rows(condition, unit, d01, d21, winner)``.
    """
    vals = ["d01", "d21", "winner"]
    left, right = _sides(rows.select(condition, unit, *vals), [unit], [condition, *vals])
    joined = pairs.join(left, f"l_{condition}").join(right, [f"r_{condition}", unit])
    by = [f"l_{condition}", f"r_{condition}"]
    up = lambda c: (F.col(f"l_{c}") <= threshold) & (F.col(f"r_{c}") > threshold)
    down = lambda c: (F.col(f"l_{c}") > threshold) & (F.col(f"r_{c}") <= threshold)
    counts = [F.count(F.lit(1)).alias("n_pairs"),
              F.count_if(up("d01")).alias("m0_up"), F.count_if(down("d01")).alias("m0_down"),
              F.count_if(up("d21")).alias("m2_up"), F.count_if(down("d21")).alias("m2_down"),
              F.count_if(F.col("l_winner") != F.col("r_winner")).alias("winner_changes")]
    joint = lambda s: F.least(F.col(f"{s}_d01"), F.col(f"{s}_d21"))
    out = grouped(joined, by, counts, {"c01": F.col("r_d01") - F.col("l_d01"), "c21": F.col("r_d21") - F.col("l_d21"),
                                       "cj": joint("r") - joint("l")}, (0.5,))
    first = lambda c: F.try_element_at(c, F.lit(1))
    return out.withColumns({"median_change_01": first("c01"), "median_change_21": first("c21"),
                            "median_change_joint": first("cj")}).drop("c01", "c21", "cj")


def _compare(joined: DataFrame, keep: Sequence[str | Column]) -> DataFrame:
    status = L.comparability(F.col("l_outcome"), F.col("r_outcome"))
    both = F.col("comparability") == "BOTH_ELIGIBLE"
    d = lambda c: F.when(both, F.col(f"r_{c}") - F.col(f"l_{c}"))
    out = joined.withColumn("comparability", status)
    return out.select(
        *keep, "comparability",
        F.when(both, L.step_label(F.col("l_selected"), F.col("r_selected"))).alias("step"),
        d("d01").alias("change_01"), d("d21").alias("change_21"), d("joint_margin").alias("change_joint"))


_VALUES = ("outcome", "selected", "d01", "d21", "joint_margin")


def window_contrast(rows: DataFrame, baseline: str = "W00") -> DataFrame:
    """Every window against the baseline window of the same event and profile."""
    left, right = _sides(rows, ["event_id", "profile_id", "window_id"], _VALUES)
    left = left.where(F.col("window_id") == baseline).drop("window_id")
    right = right.where(F.col("window_id") != baseline)
    return _compare(left.join(right.drop(*[f"l_{v}" for v in _VALUES]), ["event_id", "profile_id"]),
                    ["event_id", "profile_id", "window_id"])


def processing_contrast(rows: DataFrame, contrasts: Sequence[tuple[str, str]]) -> DataFrame:
    """Declared profile pairs within the same event and window.

    The pair list is a constant: each row is tagged with the contrasts it takes part in, and the
    two sides meet in an equi-join on (event, window, contrast).
    """
    tag = lambda side: F.array_compact(F.array(*[
        F.when(F.col("profile_id") == c[side], F.lit(f"{c[0]}>{c[1]}")) for c in contrasts]))
    keys = ["event_id", "window_id", "contrast"]
    l = rows.withColumn("contrast", F.explode(tag(0))).select(*keys, *[F.col(v).alias(f"l_{v}") for v in _VALUES])
    r = rows.withColumn("contrast", F.explode(tag(1))).select(*keys, *[F.col(v).alias(f"r_{v}") for v in _VALUES])
    return _compare(l.join(r, keys), keys)


def _step_counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("comparability") == "BOTH_ELIGIBLE").alias("comparable"),
            *[F.count_if(F.col("step") == s).alias(f"n_{s[0]}{s[2]}") for s in ("0>0", "0>1", "1>0", "1>1")]]


def contrast_totals(contrasts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Comparable pairs and the four step counts per group."""
    return contrasts.groupBy(*by).agg(*_step_counts())


def contrast_scopes(contrasts: DataFrame, sets: Sequence[Sequence[str]], columns: Sequence[str]) -> DataFrame:
    """The totals of several groupings over ``columns`` in one pass; ``scope`` names the columns of each."""
    scope = F.concat_ws("|", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns])
    return contrasts.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(scope.alias("scope"), *_step_counts())


def pair_comparison(rows: DataFrame, pair: str = "pair_id", role: str = "role",
                    left_role: str = "PUBLISHED", right_role: str = "CONTROL") -> DataFrame:
    """Same-variant comparison of the two members of each pair.

    One pass: both members of a variant meet in a grouping on (pair, window, profile), no self-join.
    """
    side = lambda r, c: F.max(F.when(F.col(role) == r, F.col(c)))
    cells = rows.groupBy(pair, "window_id", "profile_id").agg(
        side(left_role, "outcome").alias("l"), side(right_role, "outcome").alias("r")
    ).where("l is not null and r is not null")
    l, r = F.col("l"), F.col("r")
    li, ri = l == L.INADMISSIBLE, r == L.INADMISSIBLE
    incomplete = (l == L.INCOMPLETE) | (r == L.INCOMPLETE)
    both = ~li & ~ri & ~incomplete
    return cells.groupBy(pair).agg(
        F.count(F.lit(1)).alias("variants"),
        F.count_if(both).alias("both_eligible"), F.count_if(li & ri).alias("both_inadmissible"),
        F.count_if(li != ri).alias("one_inadmissible"),
        F.count_if(both & (l == r)).alias("same_selection"), F.count_if(both & (l != r)).alias("different_selection"))


def product_disagreement(rows: DataFrame, unit: str, seed: str, product: str, left: str, right: str) -> DataFrame:
    """Seed-wise disagreement between two input products of the same unit."""
    side = lambda p: F.bool_or(F.when(F.col(product) == p, F.col("selected")))
    both = rows.groupBy(unit, seed).agg(side(left).alias("l"), side(right).alias("r"))
    both = both.where("l is not null and r is not null")
    return both.groupBy(unit).agg(
        F.count(F.lit(1)).alias("compared"), F.count_if("l").alias("left_selected"),
        F.count_if("r").alias("right_selected"), F.count_if(F.col("l") != F.col("r")).alias("different"))


def mask_comparison(inputs: DataFrame, decisions: DataFrame, by: Sequence[str], seed: str, left: str, right: str) -> DataFrame:
    """Decisions on one series under two masks, paired by seed.

    ``inputs(by, mask, n, markers, sampling, status)`` from ``series.masked_inputs``, ``decisions(by, mask, seed, selected, d01, d21)``.
    ``right`` keeps a subset of what ``left`` keeps, so equal counts are equal inputs. Seeds are compared where both
    decisions are there; they count as ``compared`` only if both inputs are admissible, else as ``diagnostic``. Only an
    input that stays regular with all markers enters ``in_global``. A mask that keeps nothing leaves no row of its own:
    it counts as inadmissible.
    """
    of = lambda m, c: F.max(F.when(F.col("mask") == m, F.col(c)))
    cols = [of(m, c).alias(f"{s}_{c}") for m, s in ((left, "l"), (right, "r")) for c in ("n", "markers", "sampling", "status")]
    state = inputs.groupBy(*by).agg(*cols)
    gone = lambda c: F.coalesce(F.col(c), F.lit(L.INADMISSIBLE))
    state = state.withColumn("comparability", L.comparability(gone("l_status"), gone("r_status")))
    side = lambda m, c: F.max(F.when(F.col("mask") == m, F.col(c)))
    seeds = decisions.groupBy(*by, seed).agg(
        *[side(m, c).alias(f"_{s}_{c}") for m, s in ((left, "l"), (right, "r")) for c in ("selected", "d01", "d21")])
    both = F.col("_l_selected").isNotNull() & F.col("_r_selected").isNotNull()
    differ = F.col("_l_selected") != F.col("_r_selected")
    shift = lambda c: F.max(F.when(both, F.abs(F.col(f"_r_{c}") - F.col(f"_l_{c}"))))
    counts = seeds.groupBy(*by).agg(
        F.count_if(both).alias("_both"), F.count_if(both & differ).alias("_changed"), F.count_if(both & F.col("_l_selected")).alias("left_selected"),
        F.count_if(both & F.col("_r_selected")).alias("right_selected"), shift("d01").alias("largest_shift_01"), shift("d21").alias("largest_shift_21"))
    out = attach(state, counts, by)
    fair = F.col("comparability") == "BOTH_ELIGIBLE"
    none = F.lit(0).cast("bigint")
    pick = lambda keep, c: F.when(keep, F.coalesce(c, none)).otherwise(none)
    return out.select(
        *by, F.col("l_n").alias("n_left"), F.coalesce("r_n", none).alias("n_right"), (F.col("l_n") == F.coalesce("r_n", none)).alias("same_input"),
        F.coalesce("r_sampling", F.lit("no_samples")).alias("sampling"), F.coalesce("r_markers", F.lit("no_samples")).alias("markers"), "comparability",
        pick(fair, F.col("_both")).alias("compared"), pick(fair, F.col("_changed")).alias("changed"),
        pick(~fair, F.col("_both")).alias("diagnostic_compared"), pick(~fair, F.col("_changed")).alias("diagnostic_changed"),
        F.coalesce("left_selected", none).alias("left_selected"), F.coalesce("right_selected", none).alias("right_selected"),
        "largest_shift_01", "largest_shift_21",
        (fair & (F.col("r_sampling") == "regular") & (F.col("r_markers") == "all_markers_retained")).alias("in_global"))
