"""From model scores to decisions, baseline gates and transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions import labels as L
from evenkeel.functions.numeric import is_finite, period_errors

MODELS = ("M0", "M1", "M2")


def assemble_trios(
    fits: DataFrame,
    key: Sequence[str],
    mode: str = "error",
    ok: Column | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per ``key`` from three rows (model, score).

    ``mode='error'`` raises on a key without exactly one row per model, ``mode='skip'`` leaves
    such keys out. A complete key with a row that is not ``ok`` or not finite gets the status
    ``INCOMPLETE_NUMERICAL`` and no selection. ``carry`` columns are taken per model and come
    out as ``<name>_m0``, ``<name>_m1``, ``<name>_m2``.
    """
    good = is_finite(F.col("score")) & (F.lit(True) if ok is None else F.coalesce(ok, F.lit(False)))
    of = lambda c, m: F.max(F.when(F.col("model") == m, c))
    aggs = [of(F.col("score"), m).alias(f"bic_{m.lower()}") for m in MODELS]
    aggs += [of(F.col(c), m).alias(f"{c}_{m.lower()}") for c in carry for m in MODELS]
    aggs += [F.count_if(F.col("model") == m).alias(f"_n_{m}") for m in MODELS]
    aggs += [F.count(F.lit(1)).alias("_n"), F.count_if(~good).alias("_bad")]
    wide = fits.groupBy(*key).agg(*aggs)
    complete = (F.col("_n") == 3)
    for m in MODELS:
        complete = complete & (F.col(f"_n_{m}") == 1)
    valid = F.col("_bad") == 0
    if mode == "skip":
        wide = wide.where(complete)
    elif mode == "error":
        fail = F.raise_error(F.concat(F.lit("incomplete or repeated trio: "),
                                      F.concat_ws("|", *[F.col(k).cast("string") for k in key])))
        valid = F.when(complete, valid).otherwise(fail.cast("boolean"))
    else:
        raise ValueError(mode)
    b0, b1, b2 = (F.col(f"bic_{m.lower()}") for m in MODELS)
    out = wide.withColumn("decision_status", F.when(valid, "VALID").otherwise(L.INCOMPLETE))
    is_valid = F.col("decision_status") == "VALID"
    out = out.withColumns({"d01": F.when(is_valid, b0 - b1), "d21": F.when(is_valid, b2 - b1)})
    out = out.withColumn("selected", L.selected(F.col("d01"), F.col("d21")))
    keep = [*key, *[f"bic_{m.lower()}" for m in MODELS], "d01", "d21", "selected", "decision_status",
            *[f"{c}_{m.lower()}" for c in carry for m in MODELS]]
    return out.select(*keep)


def describe_decisions(decisions: DataFrame) -> DataFrame:
    """Margins, failure class, winner, limiting comparator of every decision."""
    d01, d21 = F.col("d01"), F.col("d21")
    scores = {m: F.col(f"bic_{m.lower()}") for m in MODELS}
    return decisions.withColumns(
        L.margins(d01, d21)
        | {"failure_class": L.failure_class(d01, d21), "winner": L.winner(scores),
           "limiting_model": L.limiting(d01, d21)}
    )


def baseline_gate(cohort: DataFrame, variants: DataFrame, decisions: DataFrame) -> DataFrame:
    """Gate state per event from its unperturbed variant.

    ``cohort(event_id, expected)``, ``variants(event_id, variant_id, is_baseline, status, reason)``,
    ``decisions(variant_id, selected, decision_status)``.
    """
    base = variants.where("is_baseline").select("event_id", "variant_id", "status", "reason")
    sel = decisions.where("decision_status = 'VALID'").select("variant_id", F.col("selected").alias("base_selected"))
    joined = cohort.join(base, "event_id", "left").join(sel, "variant_id", "left")
    available = F.col("base_selected").isNotNull()
    return joined.select(
        *cohort.columns, F.col("variant_id").alias("base_variant_id"), F.col("status").alias("base_status"),
        F.col("reason").alias("base_reason"), "base_selected",
        L.gate_state(F.col("status"), available, F.col("base_selected"), F.col("expected")).alias("gate_state"),
    )


def outcomes(variants: DataFrame, decisions: DataFrame, gate: DataFrame) -> DataFrame:
    """Every variant with its decision, its event's gate and its transition.

    A transition exists only where the gate is concordant, the input is admissible and a valid
    decision is there; everything else keeps NULL, never a negative.
    """
    dec = decisions.where("decision_status = 'VALID'").select("variant_id", "selected", "d01", "d21", "period")
    known = gate.select("event_id", "gate_state", "base_selected", "expected")
    out = variants.join(dec, "variant_id", "left").join(known, "event_id", "left")
    eligible = ((F.col("gate_state") == L.CONCORDANT) & (F.col("status") == L.ELIGIBLE)
                & F.col("selected").isNotNull())
    return out.withColumns({
        "transition_eligible": F.coalesce(eligible, F.lit(False)),
        "transition": F.when(eligible, L.transition(F.col("base_selected"), F.col("selected"))),
        "concordant": F.when(eligible, F.col("base_selected") == F.col("selected")),
        "period_role": L.period_label(F.col("selected"), F.col("period")),
        "outcome": F.when(F.col("status") == L.INADMISSIBLE, L.INADMISSIBLE)
                    .when(F.col("selected").isNull(), L.INCOMPLETE)
                    .when(F.col("selected"), "SELECTED").otherwise("NOT_SELECTED"),
    })


def period_changes(rows: DataFrame) -> DataFrame:
    """Period of each retained selection against its event's baseline period."""
    base = rows.where("is_baseline and selected").select("event_id", F.col("period").alias("base_period"))
    hit = rows.where((F.col("gate_state") == L.CONCORDANT) & F.col("base_selected") & F.col("selected"))
    hit = hit.join(base, "event_id").where(is_finite(F.col("period")) & is_finite(F.col("base_period")))
    return hit.select(
        "event_id", "variant_id", "window_id", "profile_id", "base_period", "period",
        (F.col("period") - F.col("base_period")).alias("signed_change"),
        F.abs(F.col("period") - F.col("base_period")).alias("absolute_change"),
        (F.col("period") / F.col("base_period")).alias("ratio"),
    )


def with_period_errors(df: DataFrame, estimate: str, truth: str) -> DataFrame:
    return df.withColumns(period_errors(F.col(estimate), F.col(truth)))
