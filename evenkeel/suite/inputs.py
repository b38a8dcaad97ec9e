"""Adapters from the test tables to the engine's schemas, each with the same relation in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions import labels as L
from evenkeel.functions.numeric import epoch_micros
from evenkeel.operators.ordered import number_rows
from evenkeel.operators.series import materialize_variants
from evenkeel.plans.expansion import PAD, PROFILES, WINDOWS
from evenkeel.session import materialize
from evenkeel.suite.registry import Tables

WINDOW_ORDER = tuple(w for w, _, _ in WINDOWS)
PROFILE_ORDER = tuple(p for p, *_ in PROFILES)


# --- model fits: one row per (part, line number as seed, return flag as model) ---------------

def fits(t: Tables) -> DataFrame:
    model = (F.when(F.col("l_returnflag") == "R", "M0").when(F.col("l_returnflag") == "A", "M1")
             .when(F.col("l_returnflag") == "N", "M2"))
    return t.lineitem.groupBy(
        F.col("l_partkey").alias("series_id"), (F.col("l_linenumber") - 1).cast("bigint").alias("seed"),
        model.alias("model"),
    ).agg(
        F.sum("l_quantity").alias("score"),
        F.count_if(F.col("l_discount") == 0.1).alias("bound_hits"),
        F.count_if(F.col("l_tax") == 0).alias("warnings"),
        F.round(F.sum("l_extendedprice"), 2).alias("runtime"),
        F.when(F.max("l_suppkey") % 50 == 7, "ERROR").otherwise("OK").alias("status"),
        F.array(F.max("l_discount") * 100.0 / 8.0, F.max("l_tax"), F.count_if(F.col("l_tax") == 0).cast("double")).alias("parameters"),
    )


FITS_SQL = """fits AS (
  SELECT l_partkey AS series_id, CAST(l_linenumber - 1 AS BIGINT) AS seed,
         CASE l_returnflag WHEN 'R' THEN 'M0' WHEN 'A' THEN 'M1' WHEN 'N' THEN 'M2' END AS model,
         sum(l_quantity) AS score,
         CAST(count(*) FILTER (WHERE l_discount = 0.1) AS BIGINT) AS bound_hits,
         CAST(count(*) FILTER (WHERE l_tax = 0) AS BIGINT) AS warnings,
         round(sum(l_extendedprice), 2) AS runtime,
         CASE WHEN max(l_suppkey) % 50 = 7 THEN 'ERROR' ELSE 'OK' END AS status,
         [max(l_discount) * 100.0::DOUBLE / 8, max(l_tax), count(*) FILTER (WHERE l_tax = 0)] AS parameters
  FROM lineitem GROUP BY 1, 2, 3)"""

TRIOS_SQL = FITS_SQL + """, trios AS (
  SELECT series_id, seed, b0 AS bic_m0, b1 AS bic_m1, b2 AS bic_m2,
         b0 - b1 AS d01, b2 - b1 AS d21, (b0 - b1 > 10 AND b2 - b1 > 10) AS selected,
         bounds, warnings
  FROM (SELECT series_id, seed,
               max(score) FILTER (WHERE model = 'M0') AS b0, max(score) FILTER (WHERE model = 'M1') AS b1,
               max(score) FILTER (WHERE model = 'M2') AS b2, count(*) AS n,
               CAST(sum(bound_hits) AS BIGINT) AS bounds, CAST(sum(warnings) AS BIGINT) AS warnings
        FROM fits GROUP BY 1, 2)
  WHERE n = 3)"""


# --- series and events: users as series, their largest value as the peak --------------------

def series(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    rows = number_rows(
        t.events.select("user_id", "ts", "event_id", "value", "event_type", k.alias("k")),
        ["user_id"], [F.col("ts"), F.col("event_id")], "_n")
    return rows.select(
        F.col("user_id").alias("series_id"), (F.col("_n") - 1).alias("idx"),
        ((F.col("_n") - 1) * 20.0).alias("t"), F.col("value").alias("y"),
        (F.col("value") + F.coalesce("k", F.lit(0.0))).alias("y2"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).cast("bigint").alias("quality"),
        epoch_micros(F.col("ts")).alias("us"))


def peaks(rows: DataFrame) -> DataFrame:
    """One event per series around its largest value (ties to the lowest index)."""
    peak = F.max_by(F.col("idx"), F.struct(F.col("y"), -F.col("idx")))
    ev = rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("series_rows"), peak.alias("peak_idx"))
    return ev.select(F.col("series_id").alias("event_id"), "series_id", "series_rows",
                     (F.col("peak_idx") - 10).alias("start_idx"), "peak_idx", (F.col("peak_idx") + 15).alias("end_idx"))


SERIES_SQL = """series AS MATERIALIZED (
  SELECT user_id AS series_id, CAST(row_number() OVER w - 1 AS BIGINT) AS idx,
         (row_number() OVER w - 1) * 20.0::DOUBLE AS t, value AS y,
         value + coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS y2,
         CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS quality,
         epoch_us(ts) AS us
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
ev AS MATERIALIZED (
  SELECT series_id AS event_id, series_id, CAST(n AS BIGINT) AS series_rows, peak - 10 AS start_idx,
         peak AS peak_idx, peak + 15 AS end_idx
  FROM (SELECT series_id, count(*) AS n, first(idx ORDER BY y DESC, idx) AS peak FROM series GROUP BY 1))"""

_W = ", ".join(f"('{w}', {a}, {b})" for w, a, b in WINDOWS)
_P = ", ".join(f"('{p}', '{f}', '{q}', '{d}')" for p, f, q, d in PROFILES)

CELLS_SQL = f"""cells AS (
  SELECT * FROM (VALUES {_W}) w(window_id, ds, de), (VALUES {_P}) p(profile_id, flux, policy, detrending))"""

# Profiles that see the same samples share one input, and every step is written out, so that no join order can multiply rows.
VARIANTS_SQL = SERIES_SQL + ", " + CELLS_SQL + """, planned AS MATERIALIZED (
  SELECT ev.*, cells.*, start_idx + ds AS lo, end_idx + de AS hi FROM ev, cells),
smp AS MATERIALIZED (
  SELECT p.*, s.idx, s.t, CASE WHEN flux = 'alternate' THEN s.y2 ELSE s.y END AS y,
         (policy <> 'q0_native' OR s.quality = 0) AS kept
  FROM (SELECT DISTINCT event_id, series_id, peak_idx, window_id, flux, policy, lo, hi FROM planned WHERE lo >= 0 AND hi < series_rows) p
  JOIN series s ON s.series_id = p.series_id AND s.idx BETWEEN lo AND hi),
steps AS MATERIALIZED (
  SELECT *, t - lag(t) OVER w AS d, idx - lag(idx) OVER w AS di FROM smp WHERE kept
  WINDOW w AS (PARTITION BY event_id, window_id, flux, policy ORDER BY idx)),
stats AS MATERIALIZED (
  SELECT event_id, window_id, flux, policy, count(*) AS n, bool_or(idx = peak_idx) AS peak_retained,
         coalesce(bool_and(di = 1), true) AS consecutive, quantile_cont(d, 0.5) AS median_step,
         greatest(max(d) - quantile_cont(d, 0.5), quantile_cont(d, 0.5) - min(d)) AS max_dev,
         quantile_cont(y, 0.5) AS median_y, avg(y) AS mean_y, max(y) AS max_y
  FROM steps GROUP BY 1, 2, 3, 4),
counts AS MATERIALIZED (
  SELECT event_id, window_id, flux, policy, count(*) AS raw_n,
         count(*) FILTER (WHERE kept) AS retained_n, count(*) FILTER (WHERE NOT kept) AS removed_quality
  FROM smp GROUP BY 1, 2, 3, 4),
variants AS (
  SELECT p.event_id, p.window_id, p.profile_id, p.detrending, p.lo, p.hi,
         c.raw_n, c.retained_n, c.removed_quality, s.n, s.median_step, s.max_dev, s.median_y, s.mean_y, s.max_y,
         CASE WHEN lo < 0 OR hi >= series_rows OR lo > hi THEN 'WINDOW_OUT_OF_RANGE'
              WHEN peak_idx < lo OR peak_idx > hi THEN 'PEAK_OUTSIDE_WINDOW'
              WHEN NOT coalesce(peak_retained, false) THEN 'PEAK_REMOVED_BY_QUALITY'
              WHEN coalesce(n, 0) < 15 THEN 'TOO_FEW_CADENCES'
              WHEN NOT consecutive OR max_dev > 0.001 THEN 'IRREGULAR_SAMPLING' END AS reason,
         p.window_id = 'W00' AND p.profile_id = 'P00' AS is_baseline
  FROM planned p LEFT JOIN counts c USING (event_id, window_id, flux, policy)
                 LEFT JOIN stats s USING (event_id, window_id, flux, policy))"""


def variants(t: Tables) -> DataFrame:
    rows = materialize(series(t))
    return materialize_variants(peaks(rows), rows, WINDOWS, PROFILES, PAD)


# --- decisions on variants: two scores of the retained window -------------------------------

def variant_decisions(v: DataFrame) -> DataFrame:
    ok = v.where(F.col("status") == L.ELIGIBLE)
    d01 = F.round((F.col("max_y") - F.col("median_y")) / 20.0, 6)
    d21 = F.round((F.col("max_y") - F.col("mean_y")) / 15.0, 6)
    scored = ok.select("variant_id", "event_id", "window_id", "profile_id", d01.alias("d01"), d21.alias("d21"),
                       (F.col("retained_n") * 5.0).alias("period"),
                       F.when((F.col("event_id") + F.col("retained_n")) % 29 == 0, L.INCOMPLETE)
                       .otherwise("VALID").alias("decision_status"))
    return scored.withColumn("selected", L.selected(F.col("d01"), F.col("d21")))


def cohort(t: Tables) -> DataFrame:
    """Events with the reference label each is expected to reproduce, and its pair."""
    users = t.events.select(F.col("user_id").alias("event_id")).distinct()
    return users.select(
        "event_id", F.floor(F.col("event_id") / 2).cast("bigint").alias("pair_id"),
        F.when(F.col("event_id") % 2 == 0, "PUBLISHED").otherwise("CONTROL").alias("role"),
        (F.col("event_id") % 2 == 0).alias("expected"))


OUTCOMES_SQL = VARIANTS_SQL + """, decided AS (
  SELECT *, d01 > 10 AND d21 > 10 AS selected FROM (
    SELECT event_id, window_id, profile_id, round((max_y - median_y) / 20.0, 6) AS d01,
           round((max_y - mean_y) / 15.0, 6) AS d21, retained_n * 5.0::DOUBLE AS period
    FROM variants WHERE reason IS NULL AND (event_id + retained_n) % 29 <> 0)),
cohort AS (
  SELECT DISTINCT user_id AS event_id, user_id // 2 AS pair_id,
         CASE WHEN user_id % 2 = 0 THEN 'PUBLISHED' ELSE 'CONTROL' END AS role, user_id % 2 = 0 AS expected
  FROM events),
gate AS (
  SELECT c.*, v.reason AS base_reason, d.selected AS base_selected,
         CASE WHEN v.reason IS NOT NULL THEN 'INPUT_INADMISSIBLE'
              WHEN d.selected IS NULL THEN 'INCOMPLETE_NUMERICAL'
              WHEN d.selected = c.expected THEN 'REFERENCE_CONCORDANT'
              ELSE 'REFERENCE_BASELINE_MISMATCH' END AS gate_state
  FROM cohort c JOIN variants v ON v.event_id = c.event_id AND v.is_baseline
  LEFT JOIN decided d ON d.event_id = v.event_id AND d.window_id = v.window_id AND d.profile_id = v.profile_id),
outcomes AS (
  SELECT *, CASE WHEN transition_eligible THEN CASE
              WHEN base_selected AND selected THEN 'SELECTED_RETAINED' WHEN base_selected THEN 'SELECTION_LOST'
              WHEN selected THEN 'SELECTION_GAINED' ELSE 'NOT_SELECTED_RETAINED' END END AS transition,
         transition_eligible AND base_selected = selected AS concordant
  FROM (
    SELECT v.*, d.d01, d.d21, d.period, d.selected, g.gate_state, g.base_selected, g.role, g.pair_id,
           least(d.d01 - 10, d.d21 - 10) AS joint_margin,
           coalesce(g.gate_state = 'REFERENCE_CONCORDANT' AND v.reason IS NULL AND d.selected IS NOT NULL, false)
             AS transition_eligible,
           CASE WHEN v.reason IS NOT NULL THEN 'INPUT_INADMISSIBLE' WHEN d.selected IS NULL THEN 'INCOMPLETE_NUMERICAL'
                WHEN d.selected THEN 'SELECTED' ELSE 'NOT_SELECTED' END AS outcome
    FROM variants v LEFT JOIN decided d USING (event_id, window_id, profile_id) JOIN gate g USING (event_id)))"""


def outcome_rows(t: Tables) -> DataFrame:
    """The outcome matrix, written once because several summaries read it."""
    from evenkeel.operators.decisions import baseline_gate, outcomes
    v = materialize(variants(t))
    dec = variant_decisions(v)
    members = cohort(t)
    gate = baseline_gate(members, v, dec)
    rows = outcomes(v, dec, gate)
    rows = rows.join(members.select("event_id", "role", "pair_id"), "event_id")
    return rows.withColumn("joint_margin", F.least(F.col("d01") - 10, F.col("d21") - 10))


# --- evaluation with known truth: labels as truth, document features as scores --------------

def evaluation(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "lang", "source", (F.col("n_chars") / 100.0).alias("d01"),
                              (F.size(F.split("text", " ")) / 20.0).alias("d21"), "n_chars")
    rows = t.labels.join(docs, "doc_id")
    return rows.select(
        F.col("doc_id").alias("unit"), (F.col("quality") == 1).alias("truth"), "d01", "d21", "lang", "source",
        (F.col("toxic") == 0).alias("eligible"), "n_chars",
        L.selected(F.col("d01"), F.col("d21")).alias("selected"))


EVALUATION_SQL = """evaluation AS (
  SELECT unit, truth, d01, d21, lang, source, eligible, n_chars, d01 > 10 AND d21 > 10 AS selected FROM (
    SELECT l.doc_id AS unit, l.quality = 1 AS truth, d.n_chars / 100.0::DOUBLE AS d01,
           len(string_split(d.text, ' ')) / 20.0::DOUBLE AS d21, d.lang, d.source, l.toxic = 0 AS eligible, d.n_chars
    FROM labels l JOIN documents d USING (doc_id)))"""
