"""Queries on the outcome matrix: gates, transitions, summaries, contrasts, trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions import labels as L
from evenkeel.operators import contrasts as C
from evenkeel.operators import decisions as D
from evenkeel.operators import quality as K
from evenkeel.operators import summaries as S
from evenkeel.operators import trajectories as T
from evenkeel.plans.expansion import PROFILES, WINDOWS
from evenkeel.session import materialize
from evenkeel.suite import inputs as I
from evenkeel.suite.decisions import rounded
from evenkeel.suite.registry import query

REASONS = ("IRREGULAR_SAMPLING", "TOO_FEW_CADENCES", "PEAK_REMOVED_BY_QUALITY", "PEAK_OUTSIDE_WINDOW",
           "WINDOW_OUT_OF_RANGE")

COUNTS_SQL = """CAST(count(*) AS BIGINT) AS planned, CAST(count(*) FILTER (WHERE reason IS NULL) AS BIGINT) AS eligible,
  CAST(count(*) FILTER (WHERE reason IS NOT NULL) AS BIGINT) AS inadmissible,
  CAST(count(*) FILTER (WHERE reason IS NULL AND selected IS NULL) AS BIGINT) AS incomplete,
  CAST(count(*) FILTER (WHERE transition_eligible) AS BIGINT) AS transition_eligible,
  CAST(count(*) FILTER (WHERE transition = 'SELECTED_RETAINED') AS BIGINT) AS selected_retained,
  CAST(count(*) FILTER (WHERE transition = 'SELECTION_LOST') AS BIGINT) AS selection_lost,
  CAST(count(*) FILTER (WHERE transition = 'NOT_SELECTED_RETAINED') AS BIGINT) AS not_selected_retained,
  CAST(count(*) FILTER (WHERE transition = 'SELECTION_GAINED') AS BIGINT) AS selection_gained,
  CAST(count(*) FILTER (WHERE concordant) AS BIGINT) AS concordant,
  round(count(*) FILTER (WHERE concordant) / nullif(count(*) FILTER (WHERE transition_eligible), 0)::DOUBLE, 6) AS concordance"""


@query("baseline_gate", "B26", f"""
WITH {I.OUTCOMES_SQL} SELECT event_id, role, expected, base_reason, base_selected, gate_state FROM gate""")
def _(t):
    v = materialize(I.variants(t))
    gate = D.baseline_gate(I.cohort(t), v, I.variant_decisions(v))
    return gate.select("event_id", "role", "expected", "base_reason", "base_selected", "gate_state")


@query("variant_outcomes", "C10 B27 B11", f"""
WITH {I.OUTCOMES_SQL}
SELECT event_id, window_id, profile_id, reason, d01, d21, selected, gate_state, transition_eligible, transition, outcome,
  CASE WHEN transition_eligible THEN base_selected = selected END AS concordant,
  CASE WHEN selected IS NULL THEN 'unavailable' WHEN selected THEN 'recovered_period_selected'
       ELSE 'formal_m1_center_not_selected' END AS period_role
FROM outcomes""")
def _(t):
    return I.outcome_rows(t).select(
        "event_id", "window_id", "profile_id", "reason", "d01", "d21", "selected", "gate_state", "transition_eligible",
        "transition", "outcome", "concordant", "period_role")


@query("event_summary", "D2 H7", f"""
WITH {I.OUTCOMES_SQL}
SELECT event_id, max(gate_state) AS gate_state, {COUNTS_SQL},
  {", ".join(f"CAST(count(*) FILTER (WHERE reason = '{r}') AS BIGINT) AS inadmissible_{r.lower()}" for r in REASONS)},
  coalesce(string_agg(DISTINCT profile_id, '|' ORDER BY profile_id) FILTER (WHERE transition IN ('SELECTION_LOST', 'SELECTION_GAINED')), '') AS changed_profiles,
  concat_ws('|', {", ".join(f"CASE WHEN bool_or(window_id = '{w}' AND transition IN ('SELECTION_LOST', 'SELECTION_GAINED')) THEN '{w}' END" for w in I.WINDOW_ORDER)}) AS changed_windows,
  round(min(joint_margin), 6) AS joint_margin_min, round(max(joint_margin), 6) AS joint_margin_max
FROM outcomes GROUP BY 1""")
def _(t):
    out = S.event_summary(I.outcome_rows(t), REASONS, I.WINDOW_ORDER, I.PROFILE_ORDER)
    return rounded(out, "concordance", "joint_margin_min", "joint_margin_max")


def _group_sql(by: str) -> str:
    return f"""
WITH {I.OUTCOMES_SQL}, r AS (SELECT {by}, reason, count(*) AS n FROM outcomes WHERE reason IS NOT NULL GROUP BY ALL),
m AS (SELECT {by}, '{{' || string_agg('"' || reason || '":' || n, ',' ORDER BY reason) || '}}' AS reason_counts FROM r GROUP BY ALL),
g AS (SELECT {by}, {COUNTS_SQL},
  CAST(count(DISTINCT event_id) FILTER (WHERE gate_state = 'REFERENCE_CONCORDANT') AS BIGINT) AS concordant_events
  FROM outcomes GROUP BY ALL)
SELECT g.*, coalesce(m.reason_counts, '{{}}') AS reason_counts FROM g LEFT JOIN m USING ({by})"""


@query("cell_summary", "D3", _group_sql("window_id, profile_id, role"))
def _(t):
    return rounded(S.group_summary(I.outcome_rows(t), ["window_id", "profile_id", "role"]), "concordance")


@query("window_summary", "D3", _group_sql("window_id, role"))
def _(t):
    return rounded(S.group_summary(I.outcome_rows(t), ["window_id", "role"]), "concordance")


@query("profile_summary", "D3", _group_sql("profile_id, role"))
def _(t):
    return rounded(S.group_summary(I.outcome_rows(t), ["profile_id", "role"]), "concordance")


@query("inadmissibility_scopes", "D4", f"""
WITH {I.OUTCOMES_SQL}, s AS (
  SELECT coalesce(CASE WHEN grouping(role) = 0 THEN 'role' END, CASE WHEN grouping(window_id) = 0 THEN 'window_id' END,
                  CASE WHEN grouping(profile_id) = 0 THEN 'profile_id' END, 'global') AS scope,
         coalesce(role, window_id, profile_id, 'ALL') AS scope_value, CAST(count(*) AS BIGINT) AS planned,
         count(*) FILTER (WHERE reason IS NOT NULL) AS r_all,
         {", ".join(f"count(*) FILTER (WHERE reason = '{r}') AS r_{r.lower()}" for r in REASONS)}
  FROM outcomes GROUP BY GROUPING SETS ((), (role), (window_id), (profile_id))),
u AS ({" UNION ALL ".join([f"SELECT scope, scope_value, planned, 'ALL' AS reason, CAST(r_all AS BIGINT) AS inadmissible FROM s"]
      + [f"SELECT scope, scope_value, planned, '{r}', CAST(r_{r.lower()} AS BIGINT) FROM s" for r in REASONS])})
SELECT *, round(inadmissible / planned::DOUBLE, 6) AS fraction FROM u""")
def _(t):
    return rounded(S.inadmissibility_table(I.outcome_rows(t), ["role", "window_id", "profile_id"], REASONS), "fraction")


@query("period_changes", "D17", f"""
WITH {I.OUTCOMES_SQL}, b AS (SELECT event_id, period AS base_period FROM outcomes WHERE is_baseline AND selected)
SELECT event_id, window_id, profile_id, base_period, period, period - base_period AS signed_change,
       abs(period - base_period) AS absolute_change, round(period / base_period, 6) AS ratio
FROM outcomes JOIN b USING (event_id) WHERE gate_state = 'REFERENCE_CONCORDANT' AND base_selected AND selected""")
def _(t):
    return rounded(D.period_changes(I.outcome_rows(t)).drop("variant_id"), "ratio")


@query("period_change_summary", "D17 D5", f"""
WITH {I.OUTCOMES_SQL}, b AS (SELECT event_id, period AS bp FROM outcomes WHERE is_baseline AND selected),
c AS (SELECT period - bp AS signed_change, abs(period - bp) AS absolute_change, period / bp AS ratio
      FROM outcomes JOIN b USING (event_id) WHERE gate_state = 'REFERENCE_CONCORDANT' AND base_selected AND selected),
u AS (SELECT 'signed_change' AS quantity, signed_change AS x FROM c UNION ALL SELECT 'absolute_change', absolute_change FROM c
      UNION ALL SELECT 'ratio', ratio FROM c)
SELECT quantity, CAST(count(*) AS BIGINT) AS n, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q1,
  round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS max FROM u GROUP BY 1""")
def _(t):
    rows = D.period_changes(I.outcome_rows(t))
    names = ("signed_change", "absolute_change", "ratio")
    out = S.six_numbers(rows, [], {c: F.col(c) for c in names})
    return rounded(out, "min", "q1", "median", "q3", "max")


COMPARE_SQL = """CASE WHEN l.outcome = 'INCOMPLETE_NUMERICAL' OR r.outcome = 'INCOMPLETE_NUMERICAL' THEN 'INCOMPLETE_NUMERICAL'
  WHEN l.outcome = 'INPUT_INADMISSIBLE' AND r.outcome = 'INPUT_INADMISSIBLE' THEN 'BOTH_INADMISSIBLE'
  WHEN l.outcome = 'INPUT_INADMISSIBLE' THEN 'REFERENCE_INADMISSIBLE'
  WHEN r.outcome = 'INPUT_INADMISSIBLE' THEN 'VARIANT_INADMISSIBLE' ELSE 'BOTH_ELIGIBLE' END AS comparability,
  CASE WHEN l.selected IS NOT NULL AND r.selected IS NOT NULL THEN (l.selected::INT) || '>' || (r.selected::INT) END AS step,
  round(r.d01 - l.d01, 6) AS change_01, round(r.d21 - l.d21, 6) AS change_21, round(r.joint_margin - l.joint_margin, 6) AS change_joint"""
CHANGES = ("change_01", "change_21", "change_joint")


@query("window_contrasts", "C14 B28", f"""
WITH {I.OUTCOMES_SQL} SELECT r.event_id, r.profile_id, r.window_id, {COMPARE_SQL}
FROM outcomes l JOIN outcomes r ON l.event_id = r.event_id AND l.profile_id = r.profile_id
 AND l.window_id = 'W00' AND r.window_id <> 'W00'""")
def _(t):
    return rounded(C.window_contrast(I.outcome_rows(t)), *CHANGES)


PROFILE_PAIRS = (("P00", "P01"), ("P00", "P02"), ("P01", "P03"), ("P00", "P04"), ("P01", "P05"), ("P04", "P05"))


@query("processing_contrasts", "C15 B28", f"""
WITH {I.OUTCOMES_SQL} SELECT r.event_id, r.window_id, c.a || '>' || c.b AS contrast, {COMPARE_SQL}
FROM (VALUES {", ".join(str(p) for p in PROFILE_PAIRS)}) c(a, b) JOIN outcomes l ON l.profile_id = c.a
JOIN outcomes r ON r.profile_id = c.b AND l.event_id = r.event_id AND l.window_id = r.window_id""")
def _(t):
    return rounded(C.processing_contrast(I.outcome_rows(t), PROFILE_PAIRS), *CHANGES)


@query("window_contrast_totals", "D26", f"""
WITH {I.OUTCOMES_SQL}, c AS (SELECT r.profile_id, r.window_id, {COMPARE_SQL}
FROM outcomes l JOIN outcomes r ON l.event_id = r.event_id AND l.profile_id = r.profile_id
 AND l.window_id = 'W00' AND r.window_id <> 'W00')
SELECT profile_id, window_id, CAST(count(*) AS BIGINT) AS pairs,
  CAST(count(*) FILTER (WHERE comparability = 'BOTH_ELIGIBLE') AS BIGINT) AS comparable,
  {", ".join(f"CAST(count(*) FILTER (WHERE step = '{a}>{b}') AS BIGINT) AS n_{a}{b}" for a in (0, 1) for b in (0, 1))}
FROM c GROUP BY 1, 2""")
def _(t):
    return C.contrast_totals(C.window_contrast(I.outcome_rows(t)), ["profile_id", "window_id"])


@query("role_contrast_totals", "D26", f"""
WITH {I.OUTCOMES_SQL}, c AS (SELECT r.role, r.profile_id, {COMPARE_SQL}
FROM outcomes l JOIN outcomes r ON l.event_id = r.event_id AND l.profile_id = r.profile_id
 AND l.window_id = 'W00' AND r.window_id <> 'W00')
SELECT role, profile_id, CAST(count(*) AS BIGINT) AS pairs,
  CAST(count(*) FILTER (WHERE comparability = 'BOTH_ELIGIBLE') AS BIGINT) AS comparable,
  {", ".join(f"CAST(count(*) FILTER (WHERE step = '{a}>{b}') AS BIGINT) AS n_{a}{b}" for a in (0, 1) for b in (0, 1))}
FROM c GROUP BY 1, 2""")
def _(t):
    rows = I.outcome_rows(t)
    role = rows.select("event_id", "role").distinct()
    return C.contrast_totals(C.window_contrast(rows).drop("role").join(role, "event_id"), ["role", "profile_id"])


def scope_sql(columns, sets):
    """Step totals over GROUPING SETS of ``c``, with the name of each scope."""
    names = ", ".join(f"CASE WHEN grouping({c}) = 0 THEN '{c}' END" for c in columns)
    return f"""SELECT {", ".join(columns)}, concat_ws('|', {names}) AS scope, CAST(count(*) AS BIGINT) AS pairs,
  CAST(count(*) FILTER (WHERE comparability = 'BOTH_ELIGIBLE') AS BIGINT) AS comparable,
  {", ".join(f"CAST(count(*) FILTER (WHERE step = '{a}>{b}') AS BIGINT) AS n_{a}{b}" for a in (0, 1) for b in (0, 1))}
FROM c GROUP BY GROUPING SETS ({", ".join(f"({', '.join(s)})" for s in sets)})"""


ROLE_COLUMNS = ("role", "profile_id", "window_id")
ROLE_SETS = (("role", "profile_id", "window_id"), ("role", "profile_id"), ("role", "window_id"), ("role",))


@query("role_window_contrast_totals", "D26", f"""
WITH {I.OUTCOMES_SQL}, c AS (SELECT r.role, r.profile_id, r.window_id, {COMPARE_SQL}
FROM outcomes l JOIN outcomes r ON l.event_id = r.event_id AND l.profile_id = r.profile_id AND l.window_id = 'W00' AND r.window_id <> 'W00')
{scope_sql(ROLE_COLUMNS, ROLE_SETS)}""")
def _(t):
    rows = materialize(I.outcome_rows(t))
    return C.contrast_scopes(C.window_contrast(rows).join(rows.select("event_id", "role").distinct(), "event_id"), ROLE_SETS, ROLE_COLUMNS)


CONTRAST_COLUMNS = ("contrast", "role", "window_id")
CONTRAST_SETS = (("contrast", "role", "window_id"), ("contrast", "role"), ("contrast",))


@query("processing_contrast_totals", "D26 C15", f"""
WITH {I.OUTCOMES_SQL}, c AS (SELECT r.role, r.window_id, k.a || '>' || k.b AS contrast, {COMPARE_SQL}
FROM (VALUES {", ".join(str(p) for p in PROFILE_PAIRS)}) k(a, b) JOIN outcomes l ON l.profile_id = k.a
JOIN outcomes r ON r.profile_id = k.b AND l.event_id = r.event_id AND l.window_id = r.window_id)
{scope_sql(CONTRAST_COLUMNS, CONTRAST_SETS)}""")
def _(t):
    rows = materialize(I.outcome_rows(t))
    return C.contrast_scopes(C.processing_contrast(rows, PROFILE_PAIRS).join(rows.select("event_id", "role").distinct(), "event_id"), CONTRAST_SETS, CONTRAST_COLUMNS)


@query("pair_comparison", "C16", f"""
WITH {I.OUTCOMES_SQL}
SELECT l.pair_id, CAST(count(*) AS BIGINT) AS variants,
  CAST(count(*) FILTER (WHERE both_ok) AS BIGINT) AS both_eligible, CAST(count(*) FILTER (WHERE li AND ri) AS BIGINT) AS both_inadmissible,
  CAST(count(*) FILTER (WHERE li <> ri) AS BIGINT) AS one_inadmissible,
  CAST(count(*) FILTER (WHERE both_ok AND lo = ro) AS BIGINT) AS same_selection,
  CAST(count(*) FILTER (WHERE both_ok AND lo <> ro) AS BIGINT) AS different_selection
FROM (SELECT l.pair_id, l.outcome AS lo, r.outcome AS ro, l.outcome = 'INPUT_INADMISSIBLE' AS li, r.outcome = 'INPUT_INADMISSIBLE' AS ri,
        l.outcome IN ('SELECTED', 'NOT_SELECTED') AND r.outcome IN ('SELECTED', 'NOT_SELECTED') AS both_ok
      FROM outcomes l JOIN outcomes r ON l.pair_id = r.pair_id AND l.window_id = r.window_id AND l.profile_id = r.profile_id
       AND l.role = 'PUBLISHED' AND r.role = 'CONTROL') l GROUP BY 1""")
def _(t):
    return C.pair_comparison(I.outcome_rows(t))


@query("concordance_extremes", "H3", f"""
WITH {I.OUTCOMES_SQL}, c AS (
  SELECT role, window_id || profile_id AS cell, count(*) FILTER (WHERE concordant) / count(*) FILTER (WHERE transition_eligible)::DOUBLE AS f
  FROM outcomes GROUP BY 1, 2 HAVING count(*) FILTER (WHERE transition_eligible) > 0)
SELECT role, first(cell ORDER BY f, cell) AS lowest_cell, round(min(f), 6) AS lowest,
  first(cell ORDER BY f DESC, cell) AS highest_cell, round(max(f), 6) AS highest FROM c GROUP BY 1""")
def _(t):
    cells = S.group_summary(I.outcome_rows(t), ["window_id", "profile_id", "role"])
    cells = cells.withColumn("cell", F.concat("window_id", "profile_id"))
    return rounded(S.concordance_extremes(cells, "role", "cell"), "lowest", "highest")


@query("phase_counts", "G13 K4", f"""
WITH {I.OUTCOMES_SQL}, d(transition) AS (VALUES ('SELECTED_RETAINED'), ('SELECTION_LOST'), ('NOT_SELECTED_RETAINED'), ('SELECTION_GAINED'), ('NEVER_SEEN'))
SELECT d.transition, CAST(count(o.event_id) AS BIGINT) AS n FROM d LEFT JOIN outcomes o ON o.transition = d.transition GROUP BY 1""")
def _(t):
    return S.zero_filled_counts(I.outcome_rows(t), "transition", (*L.TRANSITIONS, "NEVER_SEEN"))


# --- contrasts over a design grid: windows as conditions, their length as the step ----------

DESIGN = [(f"{w}|{p}", p, de - ds) for w, ds, de in WINDOWS for p, *_ in PROFILES]
DESIGN_SQL = "design(condition, profile, len) AS (VALUES " + ", ".join(f"('{c}', '{p}', {n})" for c, p, n in DESIGN) + ")"


def _design(t):
    rows = I.outcome_rows(t).where("selected is not null").select(
        F.concat_ws("|", "window_id", "profile_id").alias("condition"), "event_id", "selected", "d01", "d21",
        F.least("d01", "d21").alias("d_min"), L.limiting(F.col("d01"), F.col("d21")).alias("winner"), "lo", "hi")
    design = t.spark.createDataFrame(DESIGN, "condition string, profile string, len int")
    return C.design_pairs(design, ["profile"], "len"), rows


PAIRS_SQL = f"""{DESIGN_SQL}, x AS (
  SELECT l.condition AS l_condition, r.condition AS r_condition, a.selected AS ls, b.selected AS rs, a.d01 AS la, b.d01 AS ra,
         a.d21 AS lb, b.d21 AS rb, a.lo AS llo, b.lo AS rlo
  FROM design l JOIN design r ON l.profile = r.profile AND l.len < r.len
  JOIN outcomes a ON a.window_id || '|' || a.profile_id = l.condition AND a.selected IS NOT NULL
  JOIN outcomes b ON b.window_id || '|' || b.profile_id = r.condition AND b.selected IS NOT NULL AND b.event_id = a.event_id)"""


@query("design_contrasts", "C12", f"""
WITH {I.OUTCOMES_SQL}, {PAIRS_SQL}
SELECT l_condition, r_condition, CAST(count(*) AS BIGINT) AS n_pairs,
  CAST(count(*) FILTER (WHERE NOT ls AND NOT rs) AS BIGINT) AS n00, CAST(count(*) FILTER (WHERE NOT ls AND rs) AS BIGINT) AS n01,
  CAST(count(*) FILTER (WHERE ls AND NOT rs) AS BIGINT) AS n10, CAST(count(*) FILTER (WHERE ls AND rs) AS BIGINT) AS n11,
  round(quantile_cont(least(ra, rb) - least(la, lb), 0.5), 5) AS median_change,
  round(count(*) FILTER (WHERE ls) / count(*)::DOUBLE, 6) AS left_rate, round(count(*) FILTER (WHERE rs) / count(*)::DOUBLE, 6) AS right_rate,
  round(count(*) FILTER (WHERE rs) / count(*)::DOUBLE - count(*) FILTER (WHERE ls) / count(*)::DOUBLE, 6) AS rate_difference
FROM x GROUP BY 1, 2""")
def _(t):
    pairs, rows = _design(t)
    out = C.paired_contrast(pairs, rows, "event_id", "d_min")
    return rounded(rounded(out, "left_rate", "right_rate", "rate_difference"), "median_change", digits=5)


@query("pairing_integrity", "C13", f"""
WITH {I.OUTCOMES_SQL}, {PAIRS_SQL}
SELECT l_condition, r_condition, CAST(count(*) AS BIGINT) AS n_pairs, CAST(count(*) FILTER (WHERE llo <> rlo) AS BIGINT) AS n_mismatched
FROM x GROUP BY 1, 2""")
def _(t):
    pairs, rows = _design(t)
    return C.pairing_integrity(pairs, rows, "event_id", ["lo"])


@query("step_contrasts", "C17", f"""
WITH {I.OUTCOMES_SQL}, {PAIRS_SQL}
SELECT l_condition, r_condition, CAST(count(*) AS BIGINT) AS n_pairs,
  CAST(count(*) FILTER (WHERE la <= 10 AND ra > 10) AS BIGINT) AS m0_up, CAST(count(*) FILTER (WHERE la > 10 AND ra <= 10) AS BIGINT) AS m0_down,
  CAST(count(*) FILTER (WHERE lb <= 10 AND rb > 10) AS BIGINT) AS m2_up, CAST(count(*) FILTER (WHERE lb > 10 AND rb <= 10) AS BIGINT) AS m2_down,
  CAST(count(*) FILTER (WHERE (la < lb - 5e-12) <> (ra < rb - 5e-12) OR (lb < la - 5e-12) <> (rb < ra - 5e-12)) AS BIGINT) AS winner_changes,
  round(quantile_cont(ra - la, 0.5), 5) AS median_change_01, round(quantile_cont(rb - lb, 0.5), 5) AS median_change_21,
  round(quantile_cont(least(ra, rb) - least(la, lb), 0.5), 5) AS median_change_joint
FROM x GROUP BY 1, 2""")
def _(t):
    pairs, rows = _design(t)
    out = C.step_contrast(pairs, rows, "event_id")
    return rounded(out, "median_change_01", "median_change_21", "median_change_joint", digits=5)


# --- trajectories: users and event types over weeks ------------------------------------------

WEEKS = (1, 2, 3, 4, 5)
TRAJ_SQL = """traj AS (
  SELECT user_id AS parent_id, event_type AS block_id, CAST(week AS BIGINT) AS n_samples, d01, d21, least(d01, d21) - 10 AS joint_margin,
         d01 > 10 AND d21 > 10 AS selected, user_id % 3 = 0 AS truth,
         CASE WHEN d01 < d21 - 5e-12 THEN 'M0' WHEN d21 < d01 - 5e-12 THEN 'M2' ELSE 'TIE' END AS limiting_model
  FROM (SELECT user_id, event_type, (epoch_us(ts) - 1704067200000000) // 604800000000 + 1 AS week,
               round(max(value) / 8.0, 6) AS d01, round(sum(value) / 15.0, 6) AS d21
        FROM events GROUP BY 1, 2, 3))"""


def _traj(t):
    from evenkeel.functions.numeric import epoch_micros
    week = (F.floor((epoch_micros(F.col("ts")) - F.lit(1704067200000000)) / F.lit(604800000000)) + 1).cast("bigint")
    g = t.events.groupBy(F.col("user_id").alias("parent_id"), F.col("event_type").alias("block_id"),
                         week.alias("n_samples")).agg(
        F.round(F.max("value") / 8.0, 6).alias("d01"), F.round(F.sum("value") / 15.0, 6).alias("d21"))
    d01, d21 = F.col("d01"), F.col("d21")
    return g.withColumns({"joint_margin": F.least(d01, d21) - 10, "selected": L.selected(d01, d21),
                          "truth": F.col("parent_id") % 3 == 0, "limiting_model": L.limiting(d01, d21)})


@query("trajectories", "E1 D24", f"""
WITH {TRAJ_SQL}, s AS (SELECT *, lag(selected) OVER w AS prev,
   bool_and(selected) OVER (PARTITION BY parent_id, block_id ORDER BY n_samples ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stays
   FROM traj WINDOW w AS (PARTITION BY parent_id, block_id ORDER BY n_samples))
SELECT parent_id, block_id, string_agg(n_samples::VARCHAR, '|' ORDER BY n_samples) AS n_sequence,
  string_agg((selected::INT)::VARCHAR, '' ORDER BY n_samples) AS selection_sequence, bool_or(selected) AS ever_selected,
  CAST(count(*) FILTER (WHERE selected) AS BIGINT) AS selected_lengths,
  CAST(count(*) FILTER (WHERE NOT prev AND selected) AS BIGINT) AS ups, CAST(count(*) FILTER (WHERE prev AND NOT selected) AS BIGINT) AS downs,
  min(n_samples) FILTER (WHERE selected) AS first_selected_n, min(n_samples) FILTER (WHERE stays) AS stable_from_n,
  '[' || string_agg(printf('%.6f', d01), ',' ORDER BY n_samples) || ']' AS d01_sequence,
  '[' || string_agg(printf('%.6f', joint_margin), ',' ORDER BY n_samples) || ']' AS joint_margin_sequence,
  string_agg(limiting_model, '|' ORDER BY n_samples) AS limiting_sequence
FROM s GROUP BY 1, 2""")
def _(t):
    return T.trajectory(_traj(t), ["parent_id", "block_id"], WEEKS)


# The first two weeks are the whole design here, so that later ones must come out as violations.
@query("undeclared_lengths", "E1 K4", f"""
WITH {TRAJ_SQL}
SELECT 'undeclared_length' AS rule, n_samples::VARCHAR AS key, count(*)::VARCHAR AS detail FROM traj WHERE n_samples NOT IN (1, 2) GROUP BY n_samples""")
def _(t):
    return T.undeclared_lengths(_traj(t), WEEKS[:2])


@query("sequence_frequencies", "D24", f"""
WITH {TRAJ_SQL}, s AS (SELECT parent_id, block_id, bool_or(truth) AS truth, string_agg((selected::INT)::VARCHAR, '' ORDER BY n_samples) AS selection_sequence FROM traj GROUP BY 1, 2)
SELECT truth, selection_sequence, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1, 2""")
def _(t):
    out = T.trajectory(_traj(t), ["truth", "parent_id", "block_id"], WEEKS)
    return out.groupBy("truth", "selection_sequence").agg(F.count(F.lit(1)).alias("n"))


STEPS_SQL = TRAJ_SQL + """, st AS (
  SELECT parent_id, block_id, truth, n_samples || '_to_' || lead(n_samples) OVER w AS step, lead(n_samples) OVER w AS nn,
    lead(d01) OVER w - d01 AS c01, lead(d21) OVER w - d21 AS c21, lead(joint_margin) OVER w - joint_margin AS cj,
    d01 <= 10 AND lead(d01) OVER w > 10 AS cross_m0_up, d01 > 10 AND lead(d01) OVER w <= 10 AS cross_m0_down,
    d21 <= 10 AND lead(d21) OVER w > 10 AS cross_m2_up, d21 > 10 AND lead(d21) OVER w <= 10 AS cross_m2_down,
    NOT selected AND lead(selected) OVER w AS selection_up, selected AND NOT lead(selected) OVER w AS selection_down
  FROM traj WINDOW w AS (PARTITION BY parent_id, block_id ORDER BY n_samples)),
steps AS (SELECT *, CASE WHEN truth THEN c01 - c21 END AS support FROM st WHERE nn IS NOT NULL)"""


@query("step_transitions", "E2", f"""
WITH {STEPS_SQL}
SELECT parent_id, block_id, truth, step, round(c01, 5) AS change_01, round(c21, 5) AS change_21, round(cj, 5) AS change_joint,
  round(support, 5) AS support_contrast,
  CASE WHEN support > 5e-12 THEN 'POSITIVE' WHEN support < -5e-12 THEN 'NEGATIVE' WHEN support IS NOT NULL THEN 'ZERO' END AS support_sign,
  cross_m0_up, cross_m0_down, cross_m2_up, cross_m2_down, selection_up, selection_down FROM steps""")
def _(t):
    out = T.steps(_traj(t), ["parent_id", "block_id"], WEEKS)
    return rounded(out, "change_01", "change_21", "change_joint", "support_contrast", digits=5)


@query("crossing_totals", "D24", f"""
WITH {STEPS_SQL}
SELECT truth, CAST(count(*) AS BIGINT) AS steps,
  {", ".join(f"CAST(count(*) FILTER (WHERE {c}) AS BIGINT) AS {c}" for c in ("cross_m0_up", "cross_m0_down", "cross_m2_up", "cross_m2_down", "selection_up", "selection_down"))}
FROM steps GROUP BY 1""")
def _(t):
    return S.crossing_totals(T.steps(_traj(t), ["parent_id", "block_id"], WEEKS), ["truth"])


@query("support_strata", "D23", f"""
WITH {STEPS_SQL}
SELECT step, block_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE support > 5e-12) AS BIGINT) AS n_positive,
  CAST(count(*) FILTER (WHERE support < -5e-12) AS BIGINT) AS n_negative, CAST(count(*) FILTER (WHERE abs(support) <= 5e-12) AS BIGINT) AS n_zero,
  round(quantile_cont(support, 0.25), 5) AS q1, round(quantile_cont(support, 0.5), 5) AS median, round(quantile_cont(support, 0.75), 5) AS q3
FROM steps WHERE support IS NOT NULL GROUP BY 1, 2""")
def _(t):
    out = S.support_strata(T.steps(_traj(t), ["parent_id", "block_id"], WEEKS), ["step", "block_id"])
    return rounded(out, "q1", "median", "q3", digits=5)


@query("selection_by_length", "D24", f"""
WITH {TRAJ_SQL} SELECT n_samples, truth, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE selected) AS BIGINT) AS n_selected
FROM traj GROUP BY 1, 2""")
def _(t):
    return _traj(t).groupBy("n_samples", "truth").agg(F.count(F.lit(1)).alias("n"), F.count_if("selected").alias("n_selected"))


@query("period_error_table", "D25 B12", f"""
WITH {TRAJ_SQL}, e AS (SELECT n_samples, block_id, selected, abs(d01 - d21) AS err FROM traj WHERE d01 > 0 AND d21 > 0)
SELECT n_samples, block_id, CAST(count(*) AS BIGINT) AS n_formal, CAST(count(*) FILTER (WHERE selected) AS BIGINT) AS n_selected,
  round(quantile_cont(err, 0.5), 5) AS formal_median, round(quantile_cont(err, 0.5) FILTER (WHERE selected), 5) AS selected_median
FROM e GROUP BY 1, 2""")
def _(t):
    rows = D.with_period_errors(_traj(t), "d01", "d21")
    return rounded(S.error_table(rows, ["n_samples", "block_id"]), "formal_median", "selected_median", digits=5)


@query("exactly_one_baseline", "K5", f"""
WITH {I.OUTCOMES_SQL} SELECT 'exactly_one' AS rule, event_id::VARCHAR AS key, (count(*) FILTER (WHERE selected AND is_baseline))::VARCHAR AS detail
FROM outcomes GROUP BY event_id HAVING count(*) FILTER (WHERE selected AND is_baseline) <> 1""")
def _(t):
    return K.exactly_one(I.outcome_rows(t), ["event_id"], F.col("is_baseline") & F.coalesce("selected", F.lit(False)))
