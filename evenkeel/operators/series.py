"""Windowed, masked, detrended series and their admissibility.

Series are long tables ``(series_id, idx, t, y, ...)``; no sample array is ever built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions import labels as L
from evenkeel.functions.numeric import is_finite
from evenkeel.operators.ordered import fits_one_task, neighbours, number_rows, quantiles
from evenkeel.operators.summaries import attach
from evenkeel.session import spread

# Reason codes in cascade order, the shortest admissible series and the
# largest admissible deviation of a step from the median step.
REASONS = ("MISSING_PRODUCT", "SOURCE_TIME_MAPPING_UNRESOLVED", "WINDOW_OUT_OF_RANGE", "PEAK_OUTSIDE_WINDOW",
           "PEAK_REMOVED_BY_QUALITY", "TOO_FEW_CADENCES", "NONFINITE_INPUT", "IRREGULAR_SAMPLING",
           "DETREND_FAILURE")
PRECEDENCE = ("GENERATION_FAILURE", "PEAK_REMOVED_BY_QUALITY", "TOO_FEW_CADENCES", "NONFINITE_INPUT",
              "IRREGULAR_SAMPLING")
MIN_SAMPLES = 15
STEP_TOLERANCE = 0.001


def flag_retained(samples: DataFrame, policy: Column, y: str = "y") -> DataFrame:
    """Add ``finite``, ``kept``: the finite mask, and the mask after the quality policy."""
    fin = is_finite(F.col("t")) & is_finite(F.col(y))
    good = F.when(policy == "q0_native", F.col("quality") == 0).otherwise(F.lit(True))
    return samples.withColumns({"finite": fin, "kept": fin & F.coalesce(good, F.lit(False))})


def mask_counts(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Raw, retained and removed counts per cause (after ``flag_retained``)."""
    return samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("raw_n"), F.count_if(F.col("kept")).alias("retained_n"),
        F.count_if(~F.col("finite")).alias("removed_nonfinite"),
        F.count_if(F.col("finite") & ~F.col("kept")).alias("removed_quality"))


def relative_time(samples: DataFrame, by: Sequence[str], scale: float = 86400.0,
                  group_rows: int | None = None) -> DataFrame:
    """Add ``rel_t``: seconds since the first sample (lowest ``idx``) of the group."""
    if fits_one_task(samples, by, group_rows):
        w = Window.partitionBy(*by)
        return samples.withColumn("rel_t", (F.col("t") - F.min_by("t", "idx").over(w)) * scale)
    first = samples.groupBy(*by).agg(F.min_by("t", "idx").alias("_t0"))
    return attach(samples, first, by).withColumn("rel_t", (F.col("t") - F.col("_t0")) * scale).drop("_t0")


def regularity(samples: DataFrame, by: Sequence[str], group_rows: int | None = None,
               peak: Column | None = None, fit: bool = False, extra: Mapping[str, Column] | None = None,
               kept: Column | None = None) -> DataFrame:
    """Sampling statistics per group over rows ordered by ``idx``.

    The largest deviation from the median step needs no second pass: it is the larger of
    (max step - median) and (median - min step). With ``fit`` the linear trend and the median
    of ``y`` come out of the same aggregation. With ``kept`` only the rows that satisfy it are
    samples, while ``extra`` aggregates and the set of groups still cover every row.
    """
    bounded = fits_one_task(samples, by, group_rows)
    if group_rows is None:
        group_rows = 0 if bounded else 2**62
    only = (lambda c: c) if kept is None else (lambda c: F.when(kept, c))
    seen = neighbours(samples, by, [F.col("idx")], prev={"_pt": F.col("t"), "_pi": F.col("idx")},
                      group_rows=group_rows, among=kept)
    seen = seen.withColumns({"_d": only(F.col("t") - F.col("_pt")), "_di": only(F.col("idx") - F.col("_pi"))})
    t, y, idx = only(F.col("t")), only(F.col("y")), only(F.col("idx"))
    # A distinct aggregate next to percentiles would build one percentile buffer per time value.
    distinct = F.size(F.collect_set(t)) if bounded else F.countDistinct(t)
    aggs = [
        F.count(idx).alias("n"), F.min(idx).alias("first_idx"), F.max(idx).alias("last_idx"),
        F.coalesce(F.bool_and(F.col("_d") > 0), F.lit(True)).alias("increasing"),
        (distinct < F.count(t)).alias("duplicate_times"),
        F.coalesce(F.bool_and(F.col("_di") == 1), F.lit(True)).alias("consecutive"),
        F.min("_d").alias("_dmin"), F.max("_d").alias("_dmax"),
        F.bool_and(only(is_finite(F.col("t")) & is_finite(F.col("y")))).alias("all_finite"),
    ]
    if peak is not None:
        aggs.append(F.coalesce(F.bool_or(idx == peak), F.lit(False)).alias("peak_retained"))
    if fit:
        aggs += [F.regr_slope(y, t).alias("slope"), F.avg(y).alias("mean_y"), F.avg(t).alias("mean_t")]
    aggs += [c.alias(a) for a, c in (extra or {}).items()]
    mids = {"median_step": F.col("_d")} | ({"median_y": y} if fit else {})
    if bounded:
        out = seen.groupBy(*by).agg(*aggs, *[F.percentile(c, F.lit(0.5)).alias(a) for a, c in mids.items()])
    else:
        q = quantiles(seen, by, mids, (0.5,), 2**62)
        out = attach(seen.groupBy(*by).agg(*aggs), q, by).withColumns(
            {a: F.try_element_at(a, F.lit(1)) for a in mids})
    dev = F.greatest(F.col("_dmax") - F.col("median_step"), F.col("median_step") - F.col("_dmin"))
    return out.withColumn("max_step_deviation", dev).drop("_dmin", "_dmax")


def irregular_details(consecutive_label: str = "retained_indices_not_consecutive") -> Column:
    """``a|b|c`` of the regularity conditions that fail."""
    return F.array_join(F.array_compact(F.array(
        F.when(~F.col("increasing"), "time_not_strictly_increasing"),
        F.when(F.col("duplicate_times"), "duplicate_times"),
        F.when(~F.col("consecutive"), consecutive_label),
        F.when(F.col("max_step_deviation") > STEP_TOLERANCE, "interval_deviation_gt_0.001_s"),
    )), "|")


def first_reason(product_ok: Column, mapping_ok: Column, lo: Column, hi: Column, rows: Column, peak: Column,
                 detrended: Column) -> Column:
    """First failing admissibility condition, NULL when the input is admissible.

    Works on the columns of ``regularity`` (NULL when nothing was retained).
    """
    irregular = ((~F.col("increasing")) | F.col("duplicate_times") | (~F.col("consecutive"))
                 | (F.col("max_step_deviation") > STEP_TOLERANCE))
    bad_fit = detrended & ~(is_finite(F.col("median_y")) & (F.col("median_y") != 0)
                            & is_finite(F.col("slope")) & is_finite(F.col("mean_y")))
    return (F.when(~product_ok, REASONS[0])
            .when(~mapping_ok, REASONS[1])
            .when((lo < 0) | (hi >= rows) | (lo > hi), REASONS[2])
            .when((peak < lo) | (peak > hi), REASONS[3])
            .when(~F.coalesce(F.col("peak_retained"), F.lit(False)), REASONS[4])
            .when(F.coalesce(F.col("n"), F.lit(0)) < MIN_SAMPLES, REASONS[5])
            .when(~F.col("all_finite"), REASONS[6])
            .when(irregular, REASONS[7])
            .when(bad_fit, REASONS[8]))


def all_reasons(stats: DataFrame) -> DataFrame:
    """Every triggered reason, the primary one by precedence, and the irregularity details."""
    few = F.coalesce(F.col("n"), F.lit(0)) < 2
    details = F.when(few, "insufficient_points_for_regular_grid_check").otherwise(irregular_details())
    hit = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("peak_retained"), F.lit(False)), PRECEDENCE[1]),
        F.when(F.coalesce(F.col("n"), F.lit(0)) < MIN_SAMPLES, PRECEDENCE[2]),
        F.when(~F.coalesce(F.col("all_finite"), F.lit(True)), PRECEDENCE[3]),
        F.when(details != "", PRECEDENCE[4]),
    ))
    order = F.array(*[F.lit(p) for p in PRECEDENCE])
    return stats.withColumns({
        "details": details, "_hit": hit,
    }).withColumns({
        "reasons": F.array_join("_hit", "|"),
        "primary_reason": F.try_element_at(F.filter(order, lambda p: F.array_contains("_hit", p)), F.lit(1)),
        "status": F.when(F.size("_hit") == 0, L.ELIGIBLE).otherwise(L.INADMISSIBLE),
    }).drop("_hit")


def bind_samples(events: DataFrame, series: DataFrame, pad: int, marker: bool = False) -> DataFrame:
    """Samples of each event's widest window, one shuffle for all of its variants.

    The window is exploded to positions so that the join is an equi-join on
    ``(series_id, idx)``: no pair outside a window is ever formed, and many events on one
    series do not meet in one task. With ``marker`` every event also keeps one row at
    position -1, so that later groupings do not lose events without any sample.
    """
    spots = F.sequence(F.greatest(F.lit(0).cast("bigint"), F.col("start_idx") - pad), F.col("end_idx") + pad)
    if marker:
        spots = F.concat(F.array(F.lit(-1).cast("bigint")), spots)
    span = events.withColumn("idx", F.explode(spots))
    return span.join(series, ["series_id", "idx"], "left" if marker else "inner")


def _inputs(windows: Sequence[tuple], profiles: Sequence[tuple]) -> Column:
    """Literal array of distinct (window, flux, policy) inputs, each with the profiles that use it."""
    rows = []
    for w, ds, de in windows:
        for flux, policy in dict.fromkeys((f, q) for _, f, q, _ in profiles):
            users = ", ".join(f"named_struct('profile_id', '{p}', 'detrending', '{d}')"
                              for p, f, q, d in profiles if (f, q) == (flux, policy))
            rows.append(f"named_struct('code', {len(rows)}, 'window_id', '{w}', 'ds', {ds}L, 'de', {de}L, 'flux', '{flux}', "
                        f"'policy', '{policy}', 'profiles', array({users}))")
    return F.expr(f"array({', '.join(rows)})")


def materialize_variants(events: DataFrame, series: DataFrame, windows: Sequence[tuple], profiles: Sequence[tuple],
                         pad: int) -> DataFrame:
    """One row per event, window and profile with statistics, first reason and status.

    ``events(event_id, series_id, series_rows, start_idx, peak_idx, end_idx)``; ``windows`` are
    (name, start shift, end shift), ``profiles`` (name, flux, policy, detrending). Profiles that
    see the same samples share one input and are told apart after the aggregation. Samples are
    shuffled once to meet their events and once to meet their input; marker rows make a join back
    to the plan unnecessary. The group bound is the measured widest window.
    """
    by = ["event_id", "code"]
    widest = events.agg(F.max(F.col("end_idx") - F.col("start_idx"))).first()[0] or 0
    group_rows = int(widest) + 2 + 2 * pad
    table = _inputs(windows, profiles)
    spots = bind_samples(events, series, pad, marker=True)
    # Placed by event before they are multiplied: the window and the aggregation over (event, input)
    # are satisfied by that placement, so the multiplied rows are never shuffled.
    spots = spread(spots.where("idx = -1 or t is not null"), "event_id").withColumn("c", F.explode(table))
    lo, hi = F.col("start_idx") + F.col("c.ds"), F.col("end_idx") + F.col("c.de")
    y = F.when(F.col("c.flux") == "alternate", F.col("y2")).otherwise(F.col("y"))
    marker = F.col("idx") == -1
    inside = (lo >= 0) & (hi < F.col("series_rows"))
    fin = is_finite(F.col("t")) & is_finite(y)
    good = F.when(F.col("c.policy") == "q0_native", F.col("quality") == 0).otherwise(F.lit(True))
    spots = spots.where(marker | (F.col("idx").between(lo, hi) & inside)).select(
        "event_id", "c.code", "idx", "t", y.alias("y"), (~marker).alias("real"), (~marker & fin).alias("finite"),
        (~marker & fin & F.coalesce(good, F.lit(False))).alias("kept"),
        "series_id", "series_rows", "start_idx", "peak_idx", "end_idx")
    same = ("series_id", "series_rows", "start_idx", "peak_idx", "end_idx")
    out = regularity(
        spots, by, group_rows=group_rows, peak=F.col("peak_idx"), fit=True, kept=F.col("kept"),
        extra={c: F.max(c) for c in same} | {
            "max_y": F.max(F.when(F.col("kept"), F.col("y"))),
            "raw_n": F.count_if("real"), "retained_n": F.count_if("kept"),
            "removed_nonfinite": F.count_if(F.col("real") & ~F.col("finite")),
            "removed_quality": F.count_if(F.col("finite") & ~F.col("kept"))})
    out = out.withColumn("c", F.element_at(table, F.col("code") + 1))
    out = out.withColumns({"lo": lo, "hi": hi, "window_id": F.col("c.window_id"), "p": F.explode("c.profiles")})
    out = out.withColumns({"profile_id": F.col("p.profile_id"), "detrending": F.col("p.detrending")}).drop("c", "p", "code")
    seen = (F.col("lo") >= 0) & (F.col("hi") < F.col("series_rows")) & (F.col("lo") <= F.col("hi"))
    keys = ("event_id", "window_id", "profile_id", "detrending", "lo", "hi", *same)
    out = out.withColumns({c: F.when(seen, F.col(c)) for c in out.columns if c not in keys})
    reason = first_reason(F.lit(True), F.lit(True), F.col("lo"), F.col("hi"), F.col("series_rows"),
                          F.col("peak_idx"), F.col("detrending") != "none")
    out = out.withColumn("reason", reason)
    return out.withColumns({
        "variant_id": F.concat_ws("|", "event_id", "window_id", "profile_id"),
        "status": F.when(F.col("reason").isNull(), L.ELIGIBLE).otherwise(L.INADMISSIBLE),
        "is_baseline": (F.col("window_id") == "W00") & (F.col("profile_id") == "P00"),
    })


def detrend(samples: DataFrame, by: Sequence[str], group_rows: int | None = None) -> DataFrame:
    """Add ``residual = 1 + (y - linear fit) / median(y)``; NULL where the fit is not usable."""
    fit = samples.groupBy(*by).agg(F.regr_slope("y", "t").alias("_b"), F.avg("y").alias("_my"),
                                   F.avg("t").alias("_mt"))
    mid = quantiles(samples, by, {"_m": F.col("y")}, (0.5,), group_rows).withColumn(
        "_med", F.try_element_at("_m", F.lit(1))).drop("_m")
    both = attach(samples, attach(fit, mid, by), by)
    trend = F.col("_my") + F.col("_b") * (F.col("t") - F.col("_mt"))
    ok = is_finite(F.col("_med")) & (F.col("_med") != 0) & is_finite(F.col("_b"))
    return both.withColumn("residual", F.when(ok, 1.0 + (F.col("y") - trend) / F.col("_med"))).drop(
        "_b", "_my", "_mt", "_med")


def prefixes(samples: DataFrame, lengths: Sequence[int], by: Sequence[str], position: str | None = None) -> DataFrame:
    """The first N samples of every parent, for each declared N; parents that are too short drop out of that N."""
    if position is None:
        samples = number_rows(samples, by, [F.col("idx")], "_pos")
        position = "_pos"
    top = max(lengths)
    sized = samples.where(F.col(position) <= top)
    n = sized.groupBy(*by).agg(F.max(position).alias("_len"))
    sized = attach(sized, n, by).withColumn("n_samples", F.explode(F.array(*[F.lit(x).cast("bigint") for x in lengths])))
    return sized.where((F.col(position) <= F.col("n_samples")) & (F.col("_len") >= F.col("n_samples"))).drop("_len", "_pos")


def mask_regimes(samples: DataFrame, peak: str = "peak_idx") -> DataFrame:
    """Each series under three mask regimes: complete, one inner sample missing, peak missing."""
    names = ("CONTIGUOUS_ALL_GOOD", "ONE_INTERNAL_NONPEAK_SAMPLE_MASKED", "PEAK_SAMPLE_MASKED")
    out = samples.withColumn("regime", F.explode(F.array(*[F.lit(n) for n in names])))
    gone = (((F.col("regime") == names[1]) & (F.col("idx") == F.col(peak) + 1))
            | ((F.col("regime") == names[2]) & (F.col("idx") == F.col(peak))))
    return out.where(~gone)


def carry_masks(samples: DataFrame, masks: Mapping[str, Column]) -> DataFrame:
    """Each sample once for every mask that keeps it, with the mask's name in ``mask``.

    All inputs of a series then go through one shuffle and one aggregation per (series, mask).
    """
    named = F.array_compact(F.array(*[F.when(F.coalesce(keep, F.lit(False)), F.lit(m)) for m, keep in masks.items()]))
    return samples.withColumn("mask", F.explode(named))


def masked_inputs(carried: DataFrame, by: Sequence[str], markers: Mapping[str, Column], whole: Column,
                  group_rows: int | None = None) -> DataFrame:
    """State of every (series, mask): samples, admissibility, markers that the mask has removed.

    ``markers`` name the indices that must survive (the one called ``peak`` decides admissibility), ``whole`` tells whether the
    window lies inside its series. ``sampling`` is ``regular`` or ``diagnostic_irregular_sampling``.
    """
    keys = [*by, "mask"]
    idx = F.col("idx")
    extra = {f"_m_{m}": F.coalesce(F.bool_or(idx == at), F.lit(False)) for m, at in markers.items()} | {"_whole": F.bool_and(whole)}
    stats = all_reasons(regularity(carried, keys, group_rows, peak=markers["peak"], extra=extra))
    lost = F.array_compact(F.array(*[F.when(~F.col(f"_m_{m}"), F.lit(f"{m}_marker_removed")) for m in markers]))
    few = (F.col("n") < MIN_SAMPLES) | ~F.col("peak_retained") | ~F.col("all_finite") | ~F.col("_whole")
    return stats.select(
        *keys, F.col("n"), F.when(F.size(lost) == 0, "all_markers_retained").otherwise(F.array_join(lost, "|")).alias("markers"),
        F.when(F.col("details") == "", "regular").otherwise("diagnostic_irregular_sampling").alias("sampling"),
        F.when(few, L.INADMISSIBLE).otherwise(L.ELIGIBLE).alias("status"))


def invariants(series: DataFrame, by: Sequence[str], mean: float, std: float, tol: float,
               peak: str = "peak_idx", group_rows: int | None = None) -> DataFrame:
    """Per series: finite, ends, mean and sample deviation within ``tol``, rise before and fall after the peak."""
    seen = neighbours(series, by, [F.col("idx")], prev={"_py": F.col("y")}, group_rows=group_rows)
    d = F.col("y") - F.col("_py")
    out = seen.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(is_finite(F.col("y"))).alias("all_finite"),
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.avg("y").alias("mean"),
        F.stddev_samp("y").alias("std"),
        F.coalesce(F.bool_and(F.when(F.col("_py").isNotNull() & (F.col("idx") <= F.col(peak)), d > 0)), F.lit(True))
        .alias("rises_to_peak"),
        F.coalesce(F.bool_and(F.when(F.col("_py").isNotNull() & (F.col("idx") > F.col(peak)), d < 0)), F.lit(True))
        .alias("falls_after_peak"))
    return out.withColumns({"mean_ok": F.abs(F.col("mean") - mean) <= tol, "std_ok": F.abs(F.col("std") - std) <= tol})


def temporal_contract(samples: DataFrame, by: Sequence[str], group_rows: int | None = None) -> DataFrame:
    """Mean and median step, and the two counts of positive frequencies a transform of n samples has."""
    s = regularity(samples, by, group_rows)
    ends = samples.groupBy(*by).agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    n = F.col("n")
    return attach(s, ends, by).select(
        *by, "n", "median_step", F.when(n > 1, (F.col("_b") - F.col("_a")) / (n - 1)).alias("mean_step"),
        F.floor((n - 1) / 2).cast("bigint").alias("full_positive_bins"),
        F.floor(n / 2).cast("bigint").alias("real_positive_bins"))


def contract_mismatches(expected: DataFrame, stored: DataFrame, by: Sequence[str], step_tol: float = 5.0e-12) -> DataFrame:
    """Stored step and bin count of each model row against the contract of its series."""
    e, s = expected.alias("e"), stored.alias("s")
    joined = s.join(e, list(by))
    return joined.select(
        *by, "s.model", (F.abs(F.col("s.step") - F.col("e.mean_step")) <= step_tol).alias("step_ok"),
        (F.col("s.bins") == F.col("e.full_positive_bins")).alias("bins_ok"))
