"""Queries on series: windows, masks, regularity, admissibility, detrending."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions import labels as L
from evenkeel.operators import quality as K
from evenkeel.operators import series as R
from evenkeel.operators.summaries import attach
from evenkeel.plans.expansion import PAD, cells, expand_cells
from evenkeel.suite import inputs as I
from evenkeel.suite.decisions import rounded
from evenkeel.suite.registry import query

KEY = ["event_id", "window_id", "profile_id"]


@query("cell_expansion", "C6", f"""
WITH {I.SERIES_SQL}, {I.CELLS_SQL}
SELECT event_id, window_id, profile_id, flux, policy, detrending, start_idx + ds AS lo, end_idx + de AS hi FROM ev, cells""")
def _(t):
    out = expand_cells(I.peaks(I.series(t)))
    return out.select(*KEY, "flux", "policy", "detrending", (F.col("start_idx") + F.col("ds")).alias("lo"),
                      (F.col("end_idx") + F.col("de")).alias("hi"))


@query("cell_completeness", "C6 K3", f"""
WITH {I.SERIES_SQL}, {I.CELLS_SQL}
SELECT 'group_rows' AS rule, event_id::VARCHAR AS key, count(*)::VARCHAR AS detail FROM ev, cells
WHERE start_idx + ds >= 0 AND end_idx + de < series_rows GROUP BY event_id HAVING count(*) <> 78""")
def _(t):
    full = expand_cells(I.peaks(I.series(t)))
    inside = full.where("start_idx + ds >= 0 and end_idx + de < series_rows")
    return K.group_topology(inside, ["event_id"], 78)


@query("window_slices", "C7", f"""
WITH {I.SERIES_SQL}, {I.CELLS_SQL}
SELECT event_id, window_id, CAST(count(*) AS BIGINT) AS samples, min(s.idx) AS first_idx, max(s.idx) AS last_idx,
       round(sum(y), 4) AS sum_y
FROM (SELECT DISTINCT ev.*, window_id, start_idx + ds AS lo, end_idx + de AS hi FROM ev, cells) p
JOIN series s ON s.series_id = p.series_id AND s.idx BETWEEN lo AND hi GROUP BY 1, 2""")
def _(t):
    from evenkeel.plans.expansion import PROFILES, WINDOWS
    rows = I.series(t)
    grid = cells(WINDOWS, PROFILES[:1])
    spots = R.bind_samples(I.peaks(rows), rows, PAD).withColumn("c", F.explode(grid))
    inside = spots.where("idx between start_idx + c.ds and end_idx + c.de")
    return inside.groupBy("event_id", F.col("c.window_id").alias("window_id")).agg(
        F.count(F.lit(1)).alias("samples"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"),
        F.round(F.sum("y"), 4).alias("sum_y"))


@query("variant_manifest", "F2 E3 B5", f"""
WITH {I.VARIANTS_SQL}
SELECT event_id, window_id, profile_id, lo, hi, CASE WHEN raw_n IS NOT NULL THEN coalesce(n, 0) END AS n, median_step, max_dev AS max_step_deviation, reason,
       CASE WHEN reason IS NULL THEN 'ELIGIBLE' ELSE 'INPUT_INADMISSIBLE' END AS status FROM variants""")
def _(t):
    return I.variants(t).select(*KEY, "lo", "hi", "n", "median_step", "max_step_deviation", "reason", "status")


@query("quality_mask_counts", "F1", f"""
WITH {I.VARIANTS_SQL}
SELECT event_id, window_id, profile_id, raw_n, retained_n, removed_quality FROM variants WHERE raw_n IS NOT NULL""")
def _(t):
    return I.variants(t).where("raw_n is not null").select(*KEY, "raw_n", "retained_n", "removed_quality")


@query("sampling_regularity", "E3", f"""
WITH {I.SERIES_SQL}, r AS (SELECT series_id, idx, us / 1e6::DOUBLE AS t FROM series WHERE quality = 0),
d AS (SELECT *, t - lag(t) OVER w AS d, idx - lag(idx) OVER w AS di FROM r WINDOW w AS (PARTITION BY series_id ORDER BY idx))
SELECT series_id, CAST(count(*) AS BIGINT) AS n, coalesce(bool_and(d > 0), true) AS increasing,
       count(DISTINCT t) < count(t) AS duplicate_times, coalesce(bool_and(di = 1), true) AS consecutive,
       round(quantile_cont(d, 0.5), 3) AS median_step,
       round(greatest(max(d) - quantile_cont(d, 0.5), quantile_cont(d, 0.5) - min(d)), 3) AS max_step_deviation
FROM d GROUP BY 1""")
def _(t):
    rows = I.series(t).where("quality = 0").withColumn("t", F.col("us") / 1e6)
    out = R.regularity(rows, ["series_id"])
    return rounded(out.select("series_id", "n", "increasing", "duplicate_times", "consecutive", "median_step",
                              "max_step_deviation"), "median_step", "max_step_deviation", digits=3)


@query("admissibility_all_reasons", "F3 F6", f"""
WITH {I.SERIES_SQL}, reg AS (
  SELECT s.*, peak_idx, r.regime FROM series s JOIN ev ON ev.series_id = s.series_id,
    (VALUES ('CONTIGUOUS_ALL_GOOD'), ('ONE_INTERNAL_NONPEAK_SAMPLE_MASKED'), ('PEAK_SAMPLE_MASKED')) r(regime)
  WHERE s.idx BETWEEN peak_idx - 8 AND peak_idx + 8
    AND NOT (regime = 'ONE_INTERNAL_NONPEAK_SAMPLE_MASKED' AND s.idx = peak_idx + 1)
    AND NOT (regime = 'PEAK_SAMPLE_MASKED' AND s.idx = peak_idx)),
d AS (SELECT *, t - lag(t) OVER w AS d, idx - lag(idx) OVER w AS di FROM reg WINDOW w AS (PARTITION BY series_id, regime ORDER BY idx)),
st AS (SELECT series_id, regime, count(*) AS n, bool_or(idx = peak_idx) AS pk, coalesce(bool_and(di = 1), true) AS cons,
  greatest(max(d) - quantile_cont(d, 0.5), quantile_cont(d, 0.5) - min(d)) AS dev FROM d GROUP BY 1, 2),
x AS (SELECT *, CASE WHEN n < 2 THEN 'insufficient_points_for_regular_grid_check' ELSE
  concat_ws('|', CASE WHEN NOT cons THEN 'retained_indices_not_consecutive' END,
                 CASE WHEN dev > 0.001 THEN 'interval_deviation_gt_0.001_s' END) END AS details FROM st)
SELECT series_id, regime, CAST(n AS BIGINT) AS n, details,
  concat_ws('|', CASE WHEN NOT pk THEN 'PEAK_REMOVED_BY_QUALITY' END, CASE WHEN n < 15 THEN 'TOO_FEW_CADENCES' END,
            CASE WHEN details <> '' THEN 'IRREGULAR_SAMPLING' END) AS reasons,
  CASE WHEN NOT pk THEN 'PEAK_REMOVED_BY_QUALITY' WHEN n < 15 THEN 'TOO_FEW_CADENCES'
       WHEN details <> '' THEN 'IRREGULAR_SAMPLING' END AS primary_reason,
  CASE WHEN pk AND n >= 15 AND details = '' THEN 'ELIGIBLE' ELSE 'INPUT_INADMISSIBLE' END AS status
FROM x""")
def _(t):
    rows = I.series(t)
    near = I.peaks(rows).withColumns({"start_idx": F.col("peak_idx") - 8, "end_idx": F.col("peak_idx") + 8})
    masked = R.mask_regimes(R.bind_samples(near, rows, 0))
    stats = R.regularity(masked, ["series_id", "regime"], group_rows=17, peak=F.col("peak_idx"))
    return R.all_reasons(stats).select("series_id", "regime", "n", "details", "reasons", "primary_reason", "status")


@query("detrended_series", "F4", f"""
WITH {I.SERIES_SQL}, fit AS (
  SELECT series_id, regr_slope(y, t) AS b, avg(y) AS my, avg(t) AS mt, quantile_cont(y, 0.5) AS med FROM series GROUP BY 1)
SELECT series_id, idx, round(1 + (y - (my + b * (t - mt))) / med, 5) AS residual FROM series JOIN fit USING (series_id)""")
def _(t):
    return R.detrend(I.series(t), ["series_id"]).select("series_id", "idx", F.round("residual", 5).alias("residual"))


@query("relative_time", "F5", f"""
WITH {I.SERIES_SQL}
SELECT series_id, idx, round((us - first(us) OVER (PARTITION BY series_id ORDER BY idx)) * 1e-6::DOUBLE, 3) AS rel_t FROM series""")
def _(t):
    rows = I.series(t).withColumn("t", F.col("us"))
    return R.relative_time(rows, ["series_id"], scale=1e-6).select("series_id", "idx", F.round("rel_t", 3).alias("rel_t"))


@query("mask_regimes", "F6", f"""
WITH {I.SERIES_SQL}
SELECT series_id, regime, CAST(count(*) AS BIGINT) AS n, CAST(sum(idx) AS BIGINT) AS idx_sum FROM (
  SELECT s.series_id, s.idx, peak_idx, regime FROM series s JOIN ev ON ev.series_id = s.series_id,
   (VALUES ('CONTIGUOUS_ALL_GOOD'), ('ONE_INTERNAL_NONPEAK_SAMPLE_MASKED'), ('PEAK_SAMPLE_MASKED')) r(regime))
WHERE NOT (regime = 'ONE_INTERNAL_NONPEAK_SAMPLE_MASKED' AND idx = peak_idx + 1)
  AND NOT (regime = 'PEAK_SAMPLE_MASKED' AND idx = peak_idx) GROUP BY 1, 2""")
def _(t):
    rows = I.series(t)
    marked = rows.join(I.peaks(rows).select("series_id", "peak_idx"), "series_id")
    return R.mask_regimes(marked).groupBy("series_id", "regime").agg(
        F.count(F.lit(1)).alias("n"), F.sum("idx").alias("idx_sum"))


@query("nested_prefixes", "E9", f"""
WITH {I.SERIES_SQL}, l AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS len FROM series)
SELECT series_id, n_samples, CAST(count(*) AS BIGINT) AS rows, round(sum(y), 4) AS sum_y
FROM l, (VALUES (15), (30), (60), (75)) n(n_samples) WHERE idx < n_samples AND len >= n_samples GROUP BY 1, 2""")
def _(t):
    rows = I.series(t).withColumn("pos", F.col("idx") + 1)
    out = R.prefixes(rows, (15, 30, 60, 75), ["series_id"], position="pos")
    return out.groupBy("series_id", "n_samples").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("y"), 4).alias("sum_y"))


@query("temporal_contract", "E14", f"""
WITH {I.SERIES_SQL}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY series_id ORDER BY idx) AS d FROM series)
SELECT series_id, CAST(count(*) AS BIGINT) AS n, quantile_cont(d, 0.5) AS median_step, (max(t) - min(t)) / (count(*) - 1) AS mean_step,
  CAST((count(*) - 1) // 2 AS BIGINT) AS full_positive_bins, CAST(count(*) // 2 AS BIGINT) AS real_positive_bins
FROM d GROUP BY 1""")
def _(t):
    return R.temporal_contract(I.series(t), ["series_id"])


@query("contract_mismatches", "E14", f"""
WITH {I.SERIES_SQL}, c AS (SELECT series_id, (count(*) - 1) // 2 AS bins, count(*) AS n FROM series GROUP BY 1)
SELECT series_id, model, true AS step_ok, (CASE model WHEN 'M1' THEN n // 2 ELSE bins END) = bins AS bins_ok
FROM c, (VALUES ('M0'), ('M1'), ('M2')) m(model)""")
def _(t):
    contract = R.temporal_contract(I.series(t), ["series_id"])
    stored = contract.select(
        "series_id", F.explode(F.array(F.lit("M0"), F.lit("M1"), F.lit("M2"))).alias("model"),
        F.col("median_step").alias("step"), "real_positive_bins", "full_positive_bins")
    stored = stored.withColumn("bins", F.when(F.col("model") == "M1", F.col("real_positive_bins"))
                               .otherwise(F.col("full_positive_bins"))).drop("real_positive_bins", "full_positive_bins")
    return R.contract_mismatches(contract, stored, ["series_id"])


@query("series_invariants", "F14", f"""
WITH {I.SERIES_SQL}, d AS (
  SELECT s.*, peak_idx, y - lag(y) OVER (PARTITION BY s.series_id ORDER BY idx) AS dy
  FROM series s JOIN ev ON ev.series_id = s.series_id)
SELECT series_id, CAST(count(*) AS BIGINT) AS n, true AS all_finite, min(t) AS first_t, max(t) AS last_t, round(avg(y), 6) AS mean,
  round(stddev_samp(y), 6) AS std, coalesce(bool_and(dy > 0) FILTER (WHERE idx <= peak_idx AND dy IS NOT NULL), true) AS rises_to_peak,
  coalesce(bool_and(dy < 0) FILTER (WHERE idx > peak_idx AND dy IS NOT NULL), true) AS falls_after_peak,
  abs(avg(y) - 150) <= 50 AS mean_ok, abs(stddev_samp(y) - 100) <= 50 AS std_ok
FROM d GROUP BY 1""")
def _(t):
    rows = I.series(t)
    out = R.invariants(attach(rows, I.peaks(rows).select("series_id", "peak_idx"), ["series_id"]), ["series_id"],
                       mean=150.0, std=100.0, tol=50.0)
    return rounded(out, "mean", "std")
