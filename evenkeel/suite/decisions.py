"""Queries on model fits: trios, margins, rates, stability, diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions import labels as L
from evenkeel.functions.numeric import is_finite, wilson
from evenkeel.operators import decisions as D
from evenkeel.operators import quality as K
from evenkeel.operators import summaries as S
from evenkeel.session import materialize
from evenkeel.suite import inputs as I
from evenkeel.suite.registry import query

WILSON_SQL = """greatest(0.0, (p + 3.8414588206941236 / (2.0 * n)) / (1.0 + 3.8414588206941236 / n)
   - 1.959963984540054 * sqrt(p * (1.0 - p) / n + 3.8414588206941236 / (4.0 * n * n)) / (1.0 + 3.8414588206941236 / n)) AS lo,
 least(1.0, (p + 3.8414588206941236 / (2.0 * n)) / (1.0 + 3.8414588206941236 / n)
   + 1.959963984540054 * sqrt(p * (1.0 - p) / n + 3.8414588206941236 / (4.0 * n * n)) / (1.0 + 3.8414588206941236 / n)) AS hi"""


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def trios(t):
    return D.assemble_trios(I.fits(t), ["series_id", "seed"], mode="skip")


@query("trio_decisions", "D1 B6", f"""
WITH {I.TRIOS_SQL} SELECT series_id, seed, bic_m0, bic_m1, bic_m2, d01, d21, selected FROM trios""")
def _(t):
    return trios(t).drop("decision_status")


@query("trio_status", "D1 F13", f"""
WITH {I.FITS_SQL}
SELECT CASE WHEN bad = 0 THEN 'VALID' ELSE 'INCOMPLETE_NUMERICAL' END AS decision_status,
       CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE bad = 0 AND b0 - b1 > 10 AND b2 - b1 > 10) AS BIGINT) AS n_selected
FROM (SELECT max(score) FILTER (WHERE model = 'M0') AS b0, max(score) FILTER (WHERE model = 'M1') AS b1,
             max(score) FILTER (WHERE model = 'M2') AS b2, count(*) AS n, count(*) FILTER (WHERE status <> 'OK') AS bad
      FROM fits GROUP BY series_id, seed) WHERE n = 3 GROUP BY 1""")
def _(t):
    out = D.assemble_trios(I.fits(t), ["series_id", "seed"], mode="skip", ok=F.col("status") == "OK")
    return out.groupBy("decision_status").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("selected", F.lit(False))).alias("n_selected"))


@query("score_margins", "B7 B8 B9 B10", f"""
WITH {I.TRIOS_SQL}
SELECT series_id, seed, d01 - 10 AS margin_01, d21 - 10 AS margin_21, least(d01, d21) - 10 AS joint_margin,
  CASE WHEN d01 > 10 AND d21 > 10 THEN 'BOTH_THRESHOLDS_PASSED' WHEN d01 > 10 THEN 'M0_COMPARISON_ONLY_PASSED'
       WHEN d21 > 10 THEN 'M2_COMPARISON_ONLY_PASSED' ELSE 'BOTH_COMPARISONS_FAILED' END AS failure_class,
  CASE WHEN (bic_m0 = least(bic_m0, bic_m1, bic_m2))::INT + (bic_m1 = least(bic_m0, bic_m1, bic_m2))::INT
          + (bic_m2 = least(bic_m0, bic_m1, bic_m2))::INT > 1 THEN 'TIE'
       WHEN bic_m0 = least(bic_m0, bic_m1, bic_m2) THEN 'M0'
       WHEN bic_m1 = least(bic_m0, bic_m1, bic_m2) THEN 'M1' ELSE 'M2' END AS winner,
  CASE WHEN d01 < d21 THEN 'M0' WHEN d21 < d01 THEN 'M2' ELSE 'TIE' END AS limiting_model
FROM trios""")
def _(t):
    return D.describe_decisions(trios(t)).select(
        "series_id", "seed", "margin_01", "margin_21", "joint_margin", "failure_class", "winner", "limiting_model")


@query("likelihood_gain", "B7", f"""
WITH {I.TRIOS_SQL}
SELECT series_id, seed, 2 * (bic_m0 - bic_m1) AS gain, 2 * (bic_m0 - bic_m1) - d01 AS penalty_remainder,
  CASE WHEN d01 > 5e-12 THEN 'POSITIVE' WHEN d01 < -5e-12 THEN 'NEGATIVE' ELSE 'ZERO' END AS sign FROM trios""")
def _(t):
    rows = trios(t)
    g = L.likelihood_gain(F.col("bic_m0"), F.col("bic_m1"), F.col("d01"))
    return rows.select("series_id", "seed", g["gain"].alias("gain"), g["penalty_remainder"].alias("penalty_remainder"),
                       L.sign_label(F.col("d01")).alias("sign"))


@query("selection_rate_by_brand", "D7 D8 B31", f"""
WITH {I.TRIOS_SQL}
SELECT brand, n_planned, n_valid, n_selected, round(p, 6) AS rate, round(lo, 6) AS rate_lower, round(hi, 6) AS rate_upper
FROM (SELECT *, {WILSON_SQL} FROM (
  SELECT p_brand AS brand, CAST(count(*) AS BIGINT) AS n_planned, CAST(count(*) AS BIGINT) AS n_valid,
         CAST(count(*) FILTER (WHERE selected) AS BIGINT) AS n_selected,
         count(*) FILTER (WHERE selected) / count(*)::DOUBLE AS p, count(*)::DOUBLE AS n
  FROM trios JOIN part ON p_partkey = series_id GROUP BY 1))""")
def flagship(t):
    brands = t.part.select(F.col("p_partkey").alias("series_id"), F.col("p_brand").alias("brand"))
    out = S.rate_summary(trios(t).join(brands, "series_id"), ["brand"], F.col("selected"))
    return rounded(out, "rate", "rate_lower", "rate_upper")


@query("wilson_variants", "D7", f"""
WITH {I.TRIOS_SQL}, c AS (
  SELECT seed, CAST(count(*) FILTER (WHERE selected) AS BIGINT) AS k, CAST(count(*) FILTER (WHERE d01 > 40) AS BIGINT) AS n0
  FROM trios GROUP BY 1)
SELECT seed, k, n0, round(lo, 6) AS lower, round(hi, 6) AS upper, lo IS NULL AS empty_lower
FROM (SELECT seed, k, n0, {WILSON_SQL} FROM (SELECT *, least(k, n0)::DOUBLE / nullif(n0, 0) AS p, nullif(n0, 0)::DOUBLE AS n FROM c))""")
def _(t):
    c = trios(t).groupBy("seed").agg(F.count_if("selected").alias("k"), F.count_if(F.col("d01") > 40).alias("n0"))
    lo, hi = wilson(F.least("k", "n0"), F.col("n0"))
    return c.select("seed", "k", "n0", F.round(lo, 6).alias("lower"), F.round(hi, 6).alias("upper"),
                    lo.isNull().alias("empty_lower"))


@query("condition_summary", "D6 D8", f"""
WITH {I.TRIOS_SQL}, c AS (SELECT p_type AS ptype, t.*, (bic_m1 - 25.0) AS error FROM trios t JOIN part ON p_partkey = series_id)
SELECT ptype, n_planned, n_valid, n_selected, round(p, 6) AS rate, round(lo, 6) AS rate_lower, round(hi, 6) AS rate_upper,
       bound_hit_rate, warning_rate, selected_median_error, selected_median_abs_error, selected_p90_abs_error,
       formal_median_abs_error, formal_p90_abs_error, median_d01, median_d_min
FROM (SELECT *, {WILSON_SQL} FROM (
  SELECT ptype, CAST(count(*) AS BIGINT) AS n_planned, CAST(count(*) AS BIGINT) AS n_valid,
         CAST(count(*) FILTER (WHERE selected) AS BIGINT) AS n_selected,
         count(*) FILTER (WHERE selected) / count(*)::DOUBLE AS p, count(*)::DOUBLE AS n,
         round(count(*) FILTER (WHERE bounds > 0) / count(*)::DOUBLE, 6) AS bound_hit_rate,
         round(count(*) FILTER (WHERE warnings > 0) / count(*)::DOUBLE, 6) AS warning_rate,
         round(quantile_cont(error, 0.5) FILTER (WHERE selected), 6) AS selected_median_error,
         round(quantile_cont(abs(error), 0.5) FILTER (WHERE selected), 6) AS selected_median_abs_error,
         round(quantile_cont(abs(error), 0.9) FILTER (WHERE selected), 6) AS selected_p90_abs_error,
         round(quantile_cont(abs(error), 0.5), 6) AS formal_median_abs_error,
         round(quantile_cont(abs(error), 0.9), 6) AS formal_p90_abs_error,
         round(quantile_cont(d01, 0.5), 6) AS median_d01, round(quantile_cont(least(d01, d21), 0.5), 6) AS median_d_min
  FROM c GROUP BY 1))""")
def _(t):
    kinds = t.part.select(F.col("p_partkey").alias("series_id"), F.col("p_type").alias("ptype"))
    rows = D.assemble_trios(I.fits(t), ["series_id", "seed"], mode="skip", carry=["bound_hits", "warnings"])
    total = lambda c: F.col(f"{c}_m0") + F.col(f"{c}_m1") + F.col(f"{c}_m2")
    rows = rows.withColumns({"bound_hits": total("bound_hits"), "warnings": total("warnings"),
                             "error": F.col("bic_m1") - 25.0}).join(kinds, "series_id")
    out = S.condition_summary(rows, ["ptype"])
    return rounded(out, *[c for c in out.columns if c not in ("ptype", "n_planned", "n_valid", "n_selected")])


@query("six_number_summary", "D5", """
SELECT o_orderpriority AS priority, CAST(count(*) AS BIGINT) AS n, min(o_totalprice) AS min,
       round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
       round(quantile_cont(o_totalprice, 0.75), 4) AS q3, max(o_totalprice) AS max
FROM orders GROUP BY 1""")
def _(t):
    out = S.six_numbers(t.orders.withColumnRenamed("o_orderpriority", "priority"), ["priority"],
                        {"o_totalprice": F.col("o_totalprice")}).drop("quantity")
    return rounded(out, "q1", "median", "q3", digits=4)


@query("spread_summary", "D6", """
SELECT l_linestatus AS status, CAST(count(*) AS BIGINT) AS n, round(max(l_extendedprice) - min(l_extendedprice), 4) AS range,
  round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10,
  round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.16), 4) AS p16,
  round(quantile_cont(l_extendedprice, 0.84), 4) AS p84
FROM lineitem GROUP BY 1""")
def _(t):
    out = S.spread(t.lineitem.withColumnRenamed("l_linestatus", "status"), ["status"], F.col("l_extendedprice"))
    return rounded(out, "range", "median", "p10", "p90", "p16", "p84", digits=4)


def trio_fits(t):
    """Complete trios, and their fits with one row per model.

    The fits of a trio ride along through its assembly, so that they are dealt once and nothing is joined back; only
    what later steps read is written, once because several read it.
    """
    told = ["status", "parameters", "warnings", "bound_hits"]
    fits = I.fits(t).select("series_id", "seed", "model", "score", F.struct(*told).alias("fit"))
    whole = D.assemble_trios(fits, ["series_id", "seed"], mode="skip", carry=["fit"])
    # a null key is in no join of fits and trios
    whole = materialize(whole.withColumn("_known", F.col("series_id").isNotNull() & F.col("seed").isNotNull()))
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"fit_{m.lower()}").alias("fit")) for m in D.MODELS]))
    fits = whole.where("_known").select("series_id", "seed", each).select("series_id", "seed", "model", "fit.*")
    return whole.drop("_known", *[f"fit_{m.lower()}" for m in D.MODELS]), fits


PAYLOADS_SQL = ", tf AS MATERIALIZED (SELECT f.* FROM fits f JOIN trios USING (series_id, seed)), payloads AS (SELECT series_id, " + ", ".join(
    f"CAST(count({d}) FILTER (WHERE model = '{m}'{c}) AS BIGINT) AS {n}_{m.lower()}"
    for n, d, c in (("unique_parameter_payloads", "DISTINCT parameters", ""), ("warning_calls", "*", " AND warnings > 0"), ("bound_calls", "*", " AND bound_hits > 0"))
    for m in ("M0", "M1", "M2")) + ", " + ", ".join(
    f"CAST(coalesce(sum(warnings) FILTER (WHERE model = '{m}'), 0) AS BIGINT) AS warning_count_{m.lower()}" for m in ("M0", "M1", "M2")) + """,
  string_agg(DISTINCT status, '|' ORDER BY status) AS status_set FROM tf GROUP BY 1)"""


@query("seed_stability", "D9 H7", f"""
WITH {I.TRIOS_SQL}{PAYLOADS_SQL}
SELECT *, CASE WHEN n_seeds >= 2 THEN round(2.0 * n_selected * (n_seeds - n_selected) / (n_seeds * (n_seeds - 1)), 6) END AS pair_discordance,
  CASE WHEN seed0_selected THEN n_seeds - n_selected ELSE n_selected END AS discordant_vs_seed0,
  round((CASE WHEN seed0_selected THEN n_seeds - n_selected ELSE n_selected END) / n_seeds::DOUBLE, 6) AS discordant_fraction,
  n_selected > 0 AND n_selected < n_seeds AS any_change
FROM (SELECT series_id, CAST(count(*) AS BIGINT) AS n_seeds, CAST(count(*) FILTER (WHERE selected) AS BIGINT) AS n_selected,
  arg_min(selected, seed) AS seed0_selected,
  max(bic_m0) - min(bic_m0) AS bic_m0_range, max(bic_m1) - min(bic_m1) AS bic_m1_range, max(bic_m2) - min(bic_m2) AS bic_m2_range,
  max(d01) - min(d01) AS d01_range, max(d21) - min(d21) AS d21_range,
  CAST(count(DISTINCT bic_m0) AS BIGINT) AS distinct_bic_m0, CAST(count(DISTINCT bic_m1) AS BIGINT) AS distinct_bic_m1,
  CAST(count(DISTINCT bic_m2) AS BIGINT) AS distinct_bic_m2,
  string_agg(DISTINCT CASE WHEN selected THEN 'SELECTED' ELSE 'NOT_SELECTED' END, '|' ORDER BY CASE WHEN selected THEN 'SELECTED' ELSE 'NOT_SELECTED' END) AS state_set
  FROM trios GROUP BY 1) JOIN payloads USING (series_id)""")
def _(t):
    whole, rows = trio_fits(t)
    out = S.seed_stability(whole, ["series_id"]).join(S.seed_payloads(rows, ["series_id"]), "series_id")
    return rounded(out, "pair_discordance", "discordant_fraction")


@query("seed_diagnostics", "D9 D11 D5", f"""
WITH {I.TRIOS_SQL}{PAYLOADS_SQL},
c AS (SELECT model, status, count(*) AS n FROM tf GROUP BY 1, 2),
u AS (UNPIVOT (SELECT series_id, unique_parameter_payloads_m0 AS M0, unique_parameter_payloads_m1 AS M1, unique_parameter_payloads_m2 AS M2 FROM payloads) ON M0, M1, M2 INTO NAME model VALUE x),
s AS (SELECT model, CAST(count(*) AS BIGINT) AS n, min(x)::DOUBLE AS min, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, max(x)::DOUBLE AS max FROM u GROUP BY 1)
SELECT model, CAST(count(*) AS BIGINT) AS calls, CAST(count(*) FILTER (WHERE warnings > 0) AS BIGINT) AS warning_calls, CAST(sum(warnings) AS BIGINT) AS warning_count,
  CAST(count(*) FILTER (WHERE bound_hits > 0) AS BIGINT) AS bound_calls,
  (SELECT '{{' || string_agg('"' || status || '":' || n, ',' ORDER BY status) || '}}' FROM c WHERE c.model = tf.model) AS status_counts,
  any_value(s.n) AS n, any_value(min) AS min, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3, any_value(max) AS max
FROM tf JOIN s USING (model) GROUP BY model""")
def _(t):
    _, rows = trio_fits(t)
    return S.seed_diagnostics(materialize(S.seed_payloads(rows, ["series_id"])), rows)


@query("seed_completeness", "D10", f"""
WITH {I.FITS_SQL}
SELECT series_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT seed) AS BIGINT) AS n_seeds, min(seed) AS lo, max(seed) AS hi
FROM fits WHERE model = 'M0' GROUP BY 1
HAVING NOT (count(*) = 7 AND count(DISTINCT seed) = 7 AND min(seed) = 0 AND max(seed) = 6)""")
def _(t):
    return S.seed_completeness(I.fits(t).where("model = 'M0'"), ["series_id"], 7)


@query("stability_labels", "D32", f"""
WITH {I.TRIOS_SQL}
SELECT stability, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN count(*) = count(*) FILTER (WHERE selected) THEN 'STABLE_REPRODUCTION'
              WHEN count(*) FILTER (WHERE selected) = 0 THEN 'STABLE_NOT_SELECTED' ELSE 'SEED_DEPENDENT' END AS stability
  FROM trios GROUP BY series_id) GROUP BY 1""")
def _(t):
    out = S.stability_label(S.seed_stability(trios(t), ["series_id"]))
    return out.groupBy("stability").agg(F.count(F.lit(1)).alias("n"))


@query("published_value_comparison", "D32 D30", f"""
WITH {I.TRIOS_SQL}
SELECT series_id, CAST(count(*) AS BIGINT) AS n, min(bic_m1) AS lowest, max(bic_m1) AS highest, max(p_size)::DOUBLE AS published,
  quantile_cont(bic_m1, 0.5) AS median, quantile_cont(bic_m1, 0.5) - max(p_size) AS difference,
  round(abs(quantile_cont(bic_m1, 0.5) - max(p_size)) * 100 / max(p_size), 6) AS difference_percent
FROM trios JOIN part ON p_partkey = series_id GROUP BY 1""")
def _(t):
    size = t.part.select(F.col("p_partkey").alias("series_id"), F.col("p_size").cast("double").alias("published"))
    out = S.seed_estimate(trios(t).join(size, "series_id"), ["series_id"], "bic_m1", "published")
    return rounded(out, "difference_percent")


@query("paired_product_disagreement", "D31", f"""
WITH {I.TRIOS_SQL}
SELECT a.series_id // 2 AS pair, CAST(count(*) AS BIGINT) AS compared,
  CAST(count(*) FILTER (WHERE a.selected) AS BIGINT) AS left_selected, CAST(count(*) FILTER (WHERE b.selected) AS BIGINT) AS right_selected,
  CAST(count(*) FILTER (WHERE a.selected <> b.selected) AS BIGINT) AS different
FROM trios a JOIN trios b ON a.series_id % 2 = 0 AND b.series_id = a.series_id + 1 AND a.seed = b.seed GROUP BY 1""")
def _(t):
    from evenkeel.operators.contrasts import product_disagreement

    rows = trios(t).withColumns({"pair": F.floor(F.col("series_id") / 2).cast("bigint"),
                                 "product": F.when(F.col("series_id") % 2 == 0, "L").otherwise("R")})
    return product_disagreement(rows, "pair", "seed", "product", "L", "R")


SEEDS = 10

MASKED_SQL = I.SERIES_SQL + """, w AS (SELECT ev.event_id, start_idx, peak_idx, end_idx, start_idx >= 0 AND end_idx < series_rows AS whole, s.idx, s.t, s.quality, f.flux,
    CASE f.flux WHEN 'primary' THEN s.y ELSE s.y2 END AS y
  FROM ev JOIN series s ON s.series_id = ev.series_id AND s.idx BETWEEN start_idx AND end_idx, (VALUES ('primary'), ('alternate')) f(flux)),
m AS MATERIALIZED (SELECT w.*, k.mask FROM w, (VALUES ('finite_all'), ('q0_native')) k(mask) WHERE k.mask = 'finite_all' OR quality = 0),
d AS (SELECT *, t - lag(t) OVER o AS d, idx - lag(idx) OVER o AS di FROM m WINDOW o AS (PARTITION BY event_id, flux, mask ORDER BY idx)),
st AS (SELECT event_id, flux, mask, CAST(count(*) AS BIGINT) AS n, bool_or(idx = peak_idx) AS pk, bool_or(idx = start_idx) AS sk, bool_or(idx = end_idx) AS ek, any_value(whole) AS whole,
    coalesce(bool_and(di = 1), true) AND coalesce(greatest(max(d) - quantile_cont(d, 0.5), quantile_cont(d, 0.5) - min(d)), 0) <= 0.001 AND count(*) >= 2 AS regular
  FROM d GROUP BY 1, 2, 3),
i AS (SELECT *, CASE WHEN n < 15 OR NOT pk OR NOT whole THEN 'INPUT_INADMISSIBLE' ELSE 'ELIGIBLE' END AS status,
    CASE WHEN sk AND pk AND ek THEN 'all_markers_retained' ELSE concat_ws('|', CASE WHEN NOT sk THEN 'start_marker_removed' END, CASE WHEN NOT pk THEN 'peak_marker_removed' END, CASE WHEN NOT ek THEN 'end_marker_removed' END) END AS markers FROM st),
dec AS (SELECT event_id, flux, mask, seed, round((max(y) - avg(y)) / 18.0, 6) AS d01, round((max(y) - min(y)) / 22.0, 6) AS d21
  FROM m, range(10) r(seed) WHERE (idx + seed) % 5 <> 0 GROUP BY 1, 2, 3, 4),
p AS (SELECT a.event_id, a.flux, CAST(count(*) AS BIGINT) AS b, CAST(count(*) FILTER (WHERE (a.d01 > 10 AND a.d21 > 10) <> (b.d01 > 10 AND b.d21 > 10)) AS BIGINT) AS c,
    CAST(count(*) FILTER (WHERE a.d01 > 10 AND a.d21 > 10) AS BIGINT) AS ls, CAST(count(*) FILTER (WHERE b.d01 > 10 AND b.d21 > 10) AS BIGINT) AS rs,
    max(abs(b.d01 - a.d01)) AS s01, max(abs(b.d21 - a.d21)) AS s21
  FROM dec a JOIN dec b ON a.event_id = b.event_id AND a.flux = b.flux AND a.seed = b.seed AND a.mask = 'finite_all' AND b.mask = 'q0_native' GROUP BY 1, 2),
j AS (SELECT l.event_id, l.flux, l.n AS n_left, coalesce(r.n, 0) AS n_right, l.n = coalesce(r.n, 0) AS same_input,
    CASE WHEN r.n IS NULL THEN 'no_samples' WHEN r.regular THEN 'regular' ELSE 'diagnostic_irregular_sampling' END AS sampling, coalesce(r.markers, 'no_samples') AS markers,
    CASE WHEN l.status <> 'ELIGIBLE' AND coalesce(r.status, '') <> 'ELIGIBLE' THEN 'BOTH_INADMISSIBLE' WHEN l.status <> 'ELIGIBLE' THEN 'REFERENCE_INADMISSIBLE'
      WHEN coalesce(r.status, '') <> 'ELIGIBLE' THEN 'VARIANT_INADMISSIBLE' ELSE 'BOTH_ELIGIBLE' END AS comparability
  FROM i l LEFT JOIN i r ON r.event_id = l.event_id AND r.flux = l.flux AND r.mask = 'q0_native' WHERE l.mask = 'finite_all')"""


@query("masked_unmasked_disagreement", "D31 F6 B28", f"""
WITH {MASKED_SQL}
SELECT j.*, CASE WHEN comparability = 'BOTH_ELIGIBLE' THEN coalesce(b, 0) ELSE 0 END AS compared, CASE WHEN comparability = 'BOTH_ELIGIBLE' THEN coalesce(c, 0) ELSE 0 END AS changed,
  CASE WHEN comparability <> 'BOTH_ELIGIBLE' THEN coalesce(b, 0) ELSE 0 END AS diagnostic_compared, CASE WHEN comparability <> 'BOTH_ELIGIBLE' THEN coalesce(c, 0) ELSE 0 END AS diagnostic_changed,
  coalesce(ls, 0) AS left_selected, coalesce(rs, 0) AS right_selected, round(s01, 6) AS largest_shift_01, round(s21, 6) AS largest_shift_21,
  comparability = 'BOTH_ELIGIBLE' AND sampling = 'regular' AND markers = 'all_markers_retained' AS in_global
FROM j LEFT JOIN p USING (event_id, flux)""")
def _(t):
    from evenkeel.operators import series as R
    from evenkeel.operators.contrasts import mask_comparison

    rows = I.series(t)
    spots = R.bind_samples(I.peaks(rows), rows, 0)
    flux = F.explode(F.array(F.struct(F.lit("primary").alias("flux"), F.col("y").alias("v")), F.struct(F.lit("alternate").alias("flux"), F.col("y2").alias("v"))))
    spots = spots.withColumn("_f", flux).select("event_id", "_f.flux", "idx", "t", F.col("_f.v").alias("y"), "quality", "series_rows", "start_idx", "peak_idx", "end_idx")
    by = ["event_id", "flux"]
    masks = {"finite_all": F.lit(True), "q0_native": F.col("quality") == 0}
    carried = materialize(R.carry_masks(spots.where(is_finite(F.col("t")) & is_finite(F.col("y"))), masks))
    whole = (F.col("start_idx") >= 0) & (F.col("end_idx") < F.col("series_rows"))
    markers = {m: F.col(f"{m}_idx") for m in ("start", "peak", "end")}
    inputs = R.masked_inputs(carried, by, markers, whole, group_rows=26)
    # a decision for each seed: four fifths of the samples, another fifth left out by each
    seeded = carried.withColumn("seed", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SEEDS - 1).cast("bigint")))).where((F.col("idx") + F.col("seed")) % 5 != 0)
    dec = seeded.groupBy(*by, "mask", "seed").agg(F.round((F.max("y") - F.avg("y")) / 18.0, 6).alias("d01"), F.round((F.max("y") - F.min("y")) / 22.0, 6).alias("d21"))
    dec = dec.withColumn("selected", L.selected(F.col("d01"), F.col("d21")))
    return rounded(mask_comparison(inputs, dec, by, "seed", "finite_all", "q0_native"), "largest_shift_01", "largest_shift_21")


@query("model_diagnostics", "D11", f"""
WITH {I.FITS_SQL}, placed AS (SELECT *, CASE WHEN series_id % 2 = 0 THEN 'PUBLISHED' ELSE 'CONTROL' END AS role,
  CASE WHEN seed % 2 = 0 THEN 'P00' ELSE 'P01' END AS profile, 15 * (1 + series_id % 4) AS n, 'W' || lpad((series_id % 13)::VARCHAR, 2, '0') AS window_id FROM fits)
SELECT model, seed, role, profile, n, window_id,
  concat_ws('|', CASE WHEN grouping(model) = 0 THEN 'model' END, CASE WHEN grouping(seed) = 0 THEN 'seed' END,
    CASE WHEN grouping(role) = 0 THEN 'role' END, CASE WHEN grouping(profile) = 0 THEN 'profile' END, CASE WHEN grouping(n) = 0 THEN 'n' END, CASE WHEN grouping(window_id) = 0 THEN 'window_id' END) AS scope,
  CAST(count(*) AS BIGINT) AS calls, CAST(count(*) FILTER (WHERE status = 'OK') AS BIGINT) AS ok_calls,
  CAST(count(*) FILTER (WHERE warnings > 0) AS BIGINT) AS warning_calls, CAST(sum(warnings) AS BIGINT) AS warning_total,
  CAST(count(*) FILTER (WHERE bound_hits > 0) AS BIGINT) AS bound_calls, CAST(round(sum(runtime) * 100) AS BIGINT) AS runtime_cents,
  round(count(*) FILTER (WHERE warnings > 0) / count(*)::DOUBLE, 6) AS warning_rate,
  round(count(*) FILTER (WHERE bound_hits > 0) / count(*)::DOUBLE, 6) AS bound_hit_rate
FROM placed GROUP BY GROUPING SETS ((), (model), (model, seed), (model, profile, role), (model, n), (model, window_id))""")
def _(t):
    placed = I.fits(t).withColumns({
        "role": F.when(F.col("series_id") % 2 == 0, "PUBLISHED").otherwise("CONTROL"),
        "profile": F.when(F.col("seed") % 2 == 0, "P00").otherwise("P01"), "n": 15 * (1 + F.col("series_id") % 4),
        "window_id": F.concat(F.lit("W"), F.lpad((F.col("series_id") % 13).cast("string"), 2, "0"))})
    out = S.model_diagnostics(placed, [[], ["model"], ["model", "seed"], ["model", "profile", "role"], ["model", "n"], ["model", "window_id"]],
                              ["model", "seed", "role", "profile", "n", "window_id"])
    cents = F.round(F.col("runtime_total") * 100).cast("bigint").alias("runtime_cents")
    return rounded(out, "warning_rate", "bound_hit_rate").select("*", cents).drop("runtime_total")


@query("diagnostic_status_map", "D11 B14", f"""
WITH {I.FITS_SQL}, c AS (SELECT model, status, CAST(count(*) AS BIGINT) AS n FROM fits GROUP BY 1, 2)
SELECT model, '{{' || string_agg('"' || status || '":' || n, ',' ORDER BY status) || '}}' AS status_counts FROM c GROUP BY 1""")
def _(t):
    return S.status_counts(I.fits(t), ["model"], "status")


@query("runtime_medians", "D11", f"""
WITH {I.FITS_SQL} SELECT model, round(quantile_cont(runtime, 0.5), 3) AS runtime_median FROM fits GROUP BY 1""")
def _(t):
    from evenkeel.operators.ordered import quantiles
    q = quantiles(I.fits(t), ["model"], {"q": F.col("runtime")}, (0.5,))
    return q.select("model", F.round(F.try_element_at("q", F.lit(1)), 3).alias("runtime_median"))


@query("duplicate_rows", "D28 K1", """
SELECT l_partkey, l_suppkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    return K.duplicate_keys(t.lineitem, ["l_partkey", "l_suppkey"])


@query("group_size_histogram", "D33", """
SELECT group_rows, CAST(count(*) AS BIGINT) AS groups FROM (
  SELECT CAST(count(*) AS BIGINT) AS group_rows FROM lineitem GROUP BY l_orderkey) GROUP BY 1""")
def _(t):
    return S.group_size_histogram(t.lineitem, ["l_orderkey"])
