"""Label expressions: selections, margins, winners, gates, transitions, comparability."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from evenkeel.functions.numeric import THRESHOLD, TOLERANCE, is_finite

# State names shared by every stage.
ELIGIBLE = "ELIGIBLE"
INADMISSIBLE = "INPUT_INADMISSIBLE"
INCOMPLETE = "INCOMPLETE_NUMERICAL"
CONCORDANT = "REFERENCE_CONCORDANT"
MISMATCH = "REFERENCE_BASELINE_MISMATCH"
TRANSITIONS = ("SELECTED_RETAINED", "SELECTION_LOST", "NOT_SELECTED_RETAINED", "SELECTION_GAINED")
GATES = (CONCORDANT, MISMATCH, INADMISSIBLE, INCOMPLETE)
FAILURE_CLASSES = ("BOTH_THRESHOLDS_PASSED", "M0_COMPARISON_ONLY_PASSED", "M2_COMPARISON_ONLY_PASSED", "BOTH_COMPARISONS_FAILED")


def selected(d01: Column, d21: Column, t01: float | Column = THRESHOLD, t21: float | Column = THRESHOLD,
             strict_input: bool = False) -> Column:
    """Both differences strictly above their thresholds.

    A non-finite difference gives NULL, or raises when ``strict_input`` is set. The guard is
    needed because NaN compares greater than every number.
    """
    t01 = t01 if isinstance(t01, Column) else F.lit(float(t01))
    t21 = t21 if isinstance(t21, Column) else F.lit(float(t21))
    ok = is_finite(d01) & is_finite(d21)
    rule = F.when(ok, (d01 > t01) & (d21 > t21))
    if strict_input:
        return rule.otherwise(F.raise_error(F.lit("non-finite score difference")).cast("boolean"))
    return rule


def margins(d01: Column, d21: Column, threshold: float = THRESHOLD) -> dict[str, Column]:
    a, b = d01 - threshold, d21 - threshold
    return {"margin_01": a, "margin_21": b, "joint_margin": F.least(a, b)}


def likelihood_gain(l1: Column, l_other: Column, delta: Column) -> dict[str, Column]:
    """Twice the log-likelihood gain and what the penalty term takes off it."""
    gain = 2.0 * (l1 - l_other)
    return {"gain": gain, "penalty_remainder": gain - delta}


def failure_class(d01: Column, d21: Column, threshold: float = THRESHOLD) -> Column:
    a, b = d01 > threshold, d21 > threshold
    return (F.when(~(is_finite(d01) & is_finite(d21)), F.lit(None).cast("string"))
            .when(a & b, FAILURE_CLASSES[0]).when(a, FAILURE_CLASSES[1]).when(b, FAILURE_CLASSES[2])
            .otherwise(FAILURE_CLASSES[3]))


def winner(scores: Mapping[str, Column], tol: float = TOLERANCE, tie: str = "TIE") -> Column:
    """Name of the lowest score; ``tie`` when another lies within ``tol`` of it."""
    best = F.least(*scores.values())
    near = F.filter(
        F.array(*[F.struct(F.lit(n).alias("n"), s.alias("s")) for n, s in scores.items()]),
        lambda x: F.abs(x["s"] - best) <= tol,
    )
    return F.when(F.size(near) == 1, near[0]["n"]).otherwise(tie)


def limiting(d01: Column, d21: Column, tol: float = TOLERANCE) -> Column:
    return F.when(d01 < d21 - tol, "M0").when(d21 < d01 - tol, "M2").otherwise("TIE")


def sign_label(x: Column, tol: float = TOLERANCE) -> Column:
    return (F.when(x > tol, "POSITIVE").when(x < -tol, "NEGATIVE")
            .when(x.isNotNull(), "ZERO"))


def period_label(sel: Column, period: Column) -> Column:
    return (F.when(sel.isNull() | period.isNull(), "unavailable")
            .when(sel, "recovered_period_selected")
            .otherwise("formal_m1_center_not_selected"))


def confusion_label(truth: Column, sel: Column) -> Column:
    return (F.when(truth & sel, "TP").when(truth & ~sel, "FN")
            .when(~truth & sel, "FP").when(~truth & ~sel, "TN"))


def gate_state(status: Column, available: Column, sel: Column, expected: Column) -> Column:
    """Does the baseline reproduce the reference label of its event?"""
    return (F.when(status == INADMISSIBLE, INADMISSIBLE)
            .when(~F.coalesce(available, F.lit(False)), INCOMPLETE)
            .when(sel == expected, CONCORDANT)
            .otherwise(MISMATCH))


def transition(base: Column, sel: Column) -> Column:
    return (F.when(base & sel, TRANSITIONS[0]).when(base & ~sel, TRANSITIONS[1])
            .when(~base & ~sel, TRANSITIONS[2]).when(~base & sel, TRANSITIONS[3]))


def comparability(left: Column, right: Column) -> Column:
    """State of a pair of outcomes, before any difference may be formed."""
    return (F.when((left == INCOMPLETE) | (right == INCOMPLETE), INCOMPLETE)
            .when((left == INADMISSIBLE) & (right == INADMISSIBLE), "BOTH_INADMISSIBLE")
            .when(left == INADMISSIBLE, "REFERENCE_INADMISSIBLE")
            .when(right == INADMISSIBLE, "VARIANT_INADMISSIBLE")
            .otherwise("BOTH_ELIGIBLE"))


def step_label(left: Column, right: Column) -> Column:
    """``0>0``, ``0>1``, ``1>0`` or ``1>1``."""
    return F.concat(left.cast("int").cast("string"), F.lit(">"), right.cast("int").cast("string"))


def joined(values: Column, order: Sequence[str] | None = None) -> Column:
    """``a|b|c`` from a set of strings, sorted, or in a declared order."""
    if order is None:
        return F.array_join(F.array_sort(values), "|")
    known = F.array(*[F.lit(v) for v in order])
    return F.array_join(F.filter(known, lambda v: F.array_contains(values, v)), "|")


def time_metadata_state(offset: Column, system: Column, unit: Column,
                        expected: float = 2457000.0) -> Column:
    """``COMPATIBLE`` or the first reason why a time column cannot be compared."""
    return (F.when(offset.isNull(), "OFFSET_UNREADABLE")
            .when(~F.coalesce(F.upper(system) == "TDB", F.lit(False)),
                  F.concat(F.lit("TIMESYS="), F.coalesce(system, F.lit(""))))
            .when(F.abs(offset - expected) > 1e-9, F.concat(F.lit("OFFSET="), offset.cast("string")))
            .when(~F.coalesce(F.lower(unit).isin("d", "day", "days"), F.lit(False)),
                  F.concat(F.lit("TIMEUNIT="), F.coalesce(unit, F.lit(""))))
            .otherwise("COMPATIBLE"))


def warning_types(entries: Column) -> dict[str, Column]:
    """Count, and the sorted distinct ``category: message`` texts, of an array of structs."""
    texts = F.array_sort(F.array_distinct(F.transform(
        entries, lambda e: F.concat(e["category"], F.lit(": "), e["message"]))))
    return {"warning_count": F.size(entries), "warning_types": F.to_json(texts)}
