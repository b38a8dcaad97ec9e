"""Queries with known truth: confusion, rates, selection function, thresholds, bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions import labels as L
from evenkeel.functions.numeric import period_bin
from evenkeel.operators import evaluation as E
from evenkeel.operators.thresholds import threshold_axis, threshold_search
from evenkeel.suite import inputs as I
from evenkeel.suite.decisions import WILSON_SQL, rounded
from evenkeel.suite.registry import query

CONF = """CAST(count(*) FILTER (WHERE truth AND selected) AS BIGINT) AS TP, CAST(count(*) FILTER (WHERE truth AND NOT selected) AS BIGINT) AS FN,
  CAST(count(*) FILTER (WHERE NOT truth AND NOT selected) AS BIGINT) AS TN, CAST(count(*) FILTER (WHERE NOT truth AND selected) AS BIGINT) AS FP"""


@query("confusion_matrix", "D12 B25", f"WITH {I.EVALUATION_SQL} SELECT lang, {CONF} FROM evaluation WHERE eligible GROUP BY 1")
def _(t):
    return E.confusion(I.evaluation(t), ["lang"], F.col("eligible"))


@query("classifier_rates", "D13 D7", f"""
WITH {I.EVALUATION_SQL}, c AS (SELECT {CONF} FROM evaluation WHERE eligible),
m AS (SELECT 'sensitivity' AS metric, TP AS k, TP + FN AS d FROM c UNION ALL SELECT 'specificity', TN, TN + FP FROM c
      UNION ALL SELECT 'false_positive_rate', FP, FP + TN FROM c)
SELECT metric, k AS numerator, d AS denominator, round(p, 6) AS rate, round(lo, 6) AS lower, round(hi, 6) AS upper
FROM (SELECT *, {WILSON_SQL} FROM (SELECT *, k / d::DOUBLE AS p, d::DOUBLE AS n FROM m))
UNION ALL SELECT 'balanced_accuracy', NULL, NULL, round((TP / (TP + FN)::DOUBLE + TN / (TN + FP)::DOUBLE) / 2, 6), NULL, NULL FROM c""")
def _(t):
    return rounded(E.rates(E.confusion(I.evaluation(t), eligible=F.col("eligible"))), "rate", "lower", "upper")


@query("end_to_end_metrics", "D14", f"""
WITH {I.EVALUATION_SQL}, s AS (SELECT *, CASE WHEN lang = 'en' THEN 'PRIMARY' ELSE 'CHALLENGE' END AS scope FROM evaluation
  UNION ALL SELECT *, 'ALL' FROM evaluation),
g AS (SELECT scope, count(*) AS n, count(*) FILTER (WHERE eligible) AS e, count(*) FILTER (WHERE truth) AS p,
  count(*) FILTER (WHERE truth AND eligible AND selected) AS ps, count(*) FILTER (WHERE NOT truth) AS z,
  count(*) FILTER (WHERE NOT truth AND eligible AND selected) AS zs FROM s GROUP BY 1),
m AS (SELECT scope, 'input_admissibility_fraction' AS metric, e AS k, n AS d FROM g
  UNION ALL SELECT scope, 'end_to_end_positive_recovery_fraction', ps, p FROM g
  UNION ALL SELECT scope, 'end_to_end_null_selection_fraction', zs, z FROM g)
SELECT scope, metric, CAST(k AS BIGINT) AS numerator, CAST(d AS BIGINT) AS denominator, round(p, 6) AS rate, round(lo, 6) AS lower, round(hi, 6) AS upper
FROM (SELECT *, {WILSON_SQL} FROM (SELECT *, k / d::DOUBLE AS p, d::DOUBLE AS n FROM m))""")
def _(t):
    return rounded(E.end_to_end(I.evaluation(t), "lang", "en"), "rate", "lower", "upper")


LANGS = ("en", "fr", "de", "es", "xx")
GROUPS = ("g0", "g1", "g2")


def strata_rows(t):
    rows = I.evaluation(t)
    period = (F.lit(30.0) + (F.col("n_chars") % 280)).cast("double")
    return rows.withColumns({
        "grp": F.concat(F.lit("g"), (F.substring("source", 4, 4).cast("int") % 3).cast("string")),
        "true_period": period, "estimate": (F.lit(35.0) + (F.col("n_chars") * 7) % 280).cast("double"),
        "period_bin": period_bin(period, E.PERIOD_EDGES, E.PERIOD_BINS)})


STRATA_SQL = I.EVALUATION_SQL + """, strata AS (
  SELECT *, CASE WHEN true_period >= 40 AND true_period < 63.245553203367585 THEN 'P40_63'
                 WHEN true_period >= 63.245553203367585 AND true_period < 105.83005244258362 THEN 'P63_106'
                 WHEN true_period >= 105.83005244258362 AND true_period <= 300 THEN 'P106_300' END AS period_bin
  FROM (SELECT *, 'g' || (substr(source, 4)::INT % 3) AS grp, 30.0::DOUBLE + n_chars % 280 AS true_period, 35.0::DOUBLE + (n_chars * 7) % 280 AS estimate FROM evaluation))"""

_GRID = ([("POSITIVE", l, g, "ALL") for l in LANGS for g in GROUPS]
         + [("POSITIVE_BY_PERIOD", l, g, b) for l in LANGS for g in GROUPS for b in E.PERIOD_BINS]
         + [("NULL_POOLED", l, "ALL", "ALL") for l in LANGS])


@query("selection_function", "D15 B29", f"""
WITH {STRATA_SQL}, grid(kind, lang, grp, period_bin) AS (VALUES {", ".join(map(str, _GRID))}),
r AS (SELECT 'POSITIVE' AS kind, lang, grp, 'ALL' AS period_bin, eligible, selected FROM strata WHERE truth
  UNION ALL SELECT 'POSITIVE_BY_PERIOD', lang, grp, period_bin, eligible, selected FROM strata WHERE truth
  UNION ALL SELECT 'NULL_POOLED', lang, 'ALL', 'ALL', eligible, selected FROM strata WHERE NOT truth),
g AS (SELECT grid.*, count(r.kind) AS n, count(*) FILTER (WHERE eligible) AS e, count(*) FILTER (WHERE eligible AND selected) AS s
  FROM grid LEFT JOIN r USING (kind, lang, grp, period_bin) GROUP BY ALL),
m AS (SELECT kind, lang, grp, period_bin, 'input_eligibility' AS function, e AS k, n AS d FROM g
  UNION ALL SELECT kind, lang, grp, period_bin, 'conditional_selection', s, e FROM g
  UNION ALL SELECT kind, lang, grp, period_bin, 'end_to_end_selection', s, n FROM g)
SELECT kind, lang, grp, period_bin, function, CAST(k AS BIGINT) AS numerator, CAST(d AS BIGINT) AS denominator,
  round(p, 6) AS rate, CASE WHEN p IS NOT NULL THEN round(lo, 6) END AS lower, CASE WHEN p IS NOT NULL THEN round(hi, 6) END AS upper,
  CASE WHEN d = 0 THEN 'STRUCTURAL_NO_EXPOSURE' ELSE 'ESTIMATED' END AS status
FROM (SELECT *, {WILSON_SQL} FROM (SELECT *, k / nullif(d, 0)::DOUBLE AS p, nullif(d, 0)::DOUBLE AS n FROM m))""")
def _(t):
    grid = t.spark.createDataFrame(_GRID, "kind string, lang string, grp string, period_bin string")
    out = E.selection_function(strata_rows(t), grid, ["lang", "grp"], ["lang"], "period_bin")
    return rounded(out, "rate", "lower", "upper")


@query("undeclared_strata", "D15", f"""
WITH {STRATA_SQL}, grid(kind, lang, grp, period_bin) AS (VALUES {", ".join(map(str, _GRID))}),
r AS (SELECT 'POSITIVE' AS kind, lang, grp, 'ALL' AS period_bin FROM strata WHERE truth
  UNION ALL SELECT 'POSITIVE_BY_PERIOD', lang, grp, coalesce(period_bin, 'NONE') FROM strata WHERE truth
  UNION ALL SELECT 'NULL_POOLED', lang, 'ALL', 'ALL' FROM strata WHERE NOT truth)
SELECT 'undeclared_stratum' AS rule, concat_ws('|', kind, coalesce(lang, 'NULL'), coalesce(grp, 'NULL'), period_bin) AS key, count(*) || ' rows' AS detail
FROM r WHERE NOT EXISTS (SELECT 1 FROM grid g WHERE (g.kind, g.lang, g.grp, g.period_bin) = (r.kind, r.lang, r.grp, r.period_bin))
GROUP BY r.kind, lang, grp, period_bin""")
def _(t):
    grid = t.spark.createDataFrame(_GRID, "kind string, lang string, grp string, period_bin string")
    return E.undeclared_strata(strata_rows(t), grid, ["lang", "grp"], ["lang"], "period_bin")


@query("period_recovery", "D16 B12", f"""
WITH {STRATA_SQL}, p AS (SELECT lang, CASE WHEN selected AND estimate BETWEEN 40 AND 300 THEN estimate END AS est, true_period FROM strata WHERE truth AND eligible)
SELECT lang, CAST(count(*) AS BIGINT) AS eligible_positives, CAST(count(est) AS BIGINT) AS recovered, CAST(count(*) - count(est) AS BIGINT) AS missing,
  round(count(est) / count(*)::DOUBLE, 6) AS coverage,
  {", ".join(f"round(quantile_cont({x}, {q}), 5) AS {n}_{p}" for n, x in (("absolute_error", "abs(est - true_period)"), ("relative_error", "abs(est - true_period) / true_period"), ("log_ratio", "ln(est / true_period)")) for p, q in (("p16", 0.16), ("p50", 0.5), ("p84", 0.84)))}
FROM p GROUP BY 1""")
def _(t):
    out = E.period_recovery(strata_rows(t), ["lang"])
    return rounded(rounded(out, "coverage"), *[c for c in out.columns if c.endswith(("_p16", "_p50", "_p84"))], digits=5)


@query("period_bins", "B29", f"WITH {STRATA_SQL} SELECT unit, true_period, period_bin FROM strata")
def _(t):
    return strata_rows(t).select("unit", "true_period", "period_bin")


def first_turns(t):
    """The first user and the first assistant turn of every conversation."""
    rows = t.conversations.where(F.col("role").isin("user", "assistant"))
    return rows.groupBy("conv_id", "role").agg(F.min_by(F.length("text").cast("bigint"), "turn").alias("score"))


@query("paired_background", "C11", """
SELECT conv_id, p AS positive_score, z AS null_score FROM (
  SELECT conv_id, arg_min(len(text), turn) FILTER (WHERE role = 'user') AS p, arg_min(len(text), turn) FILTER (WHERE role = 'assistant') AS z
  FROM conversations GROUP BY 1) WHERE p IS NOT NULL AND z IS NOT NULL""")
def _(t):
    return E.pair_members(first_turns(t), "conv_id", "role", "user", "assistant", ["score"])[0]


@query("unpaired_backgrounds", "C11 K8", """
SELECT 'unpaired_background' AS rule, conv_id::VARCHAR AS key, count(DISTINCT role) FILTER (WHERE role = 'user') || '|' || count(DISTINCT role) FILTER (WHERE role = 'assistant') AS detail
FROM conversations GROUP BY conv_id
HAVING count(DISTINCT role) FILTER (WHERE role IN ('user', 'assistant')) < 2""")
def _(t):
    return E.pair_members(first_turns(t), "conv_id", "role", "user", "assistant", ["score"])[1]


@query("threshold_axis", "D18", f"""
WITH {I.EVALUATION_SQL}, v AS (SELECT DISTINCT d01 FROM evaluation), n AS (SELECT d01, lead(d01) OVER (ORDER BY d01) AS nx FROM v)
SELECT DISTINCT round(threshold, 6) AS threshold FROM (
  SELECT d01 AS threshold FROM n UNION SELECT d01 + (nx - d01) / 2 FROM n WHERE nx IS NOT NULL UNION SELECT 10.0::DOUBLE)""")
def _(t):
    return threshold_axis(I.evaluation(t), "d01").select(F.round("threshold", 6).alias("threshold")).distinct()


def _axis_sql(c: str) -> str:
    return (f"(SELECT {c} AS t FROM evaluation UNION SELECT {c} + (nx - {c}) / 2 FROM (SELECT {c}, lead({c}) OVER (ORDER BY {c}) AS nx "
            f"FROM (SELECT DISTINCT {c} FROM evaluation)) WHERE nx IS NOT NULL UNION SELECT 10.0::DOUBLE)")


# The twin counts every pair of axis values over every point: the whole plane, by brute force.
@query("threshold_search", "D19", f"""
WITH {I.EVALUATION_SQL}, a1 AS {_axis_sql("d01")}, a2 AS {_axis_sql("d21")},
tot AS (SELECT count(*) FILTER (WHERE truth) AS p, count(*) FILTER (WHERE NOT truth) AS z,
  count(DISTINCT d01) AS values01, count(DISTINCT d21) AS values21 FROM evaluation),
plane AS (SELECT a1.t AS t01, a2.t AS t21, count(*) FILTER (WHERE truth AND d01 > a1.t AND d21 > a2.t) AS tp,
  count(*) FILTER (WHERE NOT truth AND d01 > a1.t AND d21 > a2.t) AS fp FROM a1, a2, evaluation GROUP BY 1, 2)
SELECT t01, t21, CAST(tp AS BIGINT) AS TP, CAST(p - tp AS BIGINT) AS FN, CAST(z - fp AS BIGINT) AS TN, CAST(fp AS BIGINT) AS FP,
  round(tp / p::DOUBLE, 6) AS sensitivity, round((z - fp) / z::DOUBLE, 6) AS specificity,
  round((tp / p::DOUBLE + (z - fp) / z::DOUBLE) / 2, 6) AS balanced_accuracy, round(abs(t01 - 10) + abs(t21 - 10), 6) AS l1_distance,
  CAST(values01 AS BIGINT) AS values01, CAST(values21 AS BIGINT) AS values21
FROM plane, tot ORDER BY tp * z - fp * p DESC, least(tp * z, (z - fp) * p) DESC, fp, abs(t01 - 10) + abs(t21 - 10), t01 DESC, t21 DESC LIMIT 1""")
def _(t):
    return rounded(threshold_search(I.evaluation(t)), "sensitivity", "specificity", "balanced_accuracy", "l1_distance")


def _rules(t):
    rows = I.evaluation(t).where("eligible")
    return rows.withColumn("candidate", L.selected(F.col("d01"), F.col("d21"), 4.0, 2.0))


REPS = 10_000
_CELLS = {"TP": "11", "FN": "10", "FP": "01", "TN": "00"}
def _draws_sql() -> str:
    """Seven binomial draws, each inverted by summing its probabilities, of what the classes before it have left."""
    out = [f"""r0 AS MATERIALIZED (SELECT rep, lang, n AS lft, n AS rest, {", ".join(f"c{c}" for c in E.CLASSES)} FROM k, range({REPS}) x(rep))"""]
    for i, c in enumerate(E.CLASSES[:-1]):
        done = "".join(f", d{x}" for x in E.CLASSES[:i])
        out.append(f"""q{i} AS MATERIALIZED (SELECT *, greatest(0.0, floor(mean - reach)) AS low, least(lft, ceil(mean + reach)) AS high, p > 0 AND p < 1 AND lft > 0 AS inside FROM (
  SELECT *, lft * p AS mean, 10 * sqrt(lft * p * (1 - p)) + 10 AS reach FROM (SELECT *, CASE WHEN rest > 0 THEN c{c} / rest::DOUBLE ELSE 0.0 END AS p,
    ('0x' || substr(sha256('boot|' || rep || '|' || lang || '|{c}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM r{i}))),
s{i} AS (SELECT rep, lang, low + count(*) FILTER (WHERE total < u) AS d FROM (SELECT rep, lang, low, u, high, j, sum(mass) OVER (PARTITION BY rep, lang ORDER BY j) / sum(mass) OVER (PARTITION BY rep, lang) AS total FROM (
  SELECT rep, lang, low, u, high, j, exp(lgamma(lft + 1) - lgamma(j + 1) - lgamma(lft - j + 1) + j * ln(p) + (lft - j) * ln(1 - p)) AS mass
  FROM (SELECT *, unnest(generate_series(low::BIGINT, high::BIGINT)) AS j FROM q{i} WHERE inside))) WHERE j < high GROUP BY rep, lang, low),
r{i + 1} AS MATERIALIZED (SELECT rep, lang, lft - d AS lft, rest - c{c} AS rest, {", ".join(f"c{x}" for x in E.CLASSES)}{done}, d AS d{c} FROM (
  SELECT q{i}.*, CASE WHEN inside THEN coalesce(s{i}.d, low) ELSE mean END::BIGINT AS d FROM q{i} LEFT JOIN s{i} USING (rep, lang)))""")
    return ",\n".join(out)


BOOT_SQL = I.EVALUATION_SQL + f""", cls AS (
  SELECT lang, truth::INT || '' || (selected::INT) || (d01 > 4 AND d21 > 2)::INT AS cls FROM evaluation WHERE eligible),
k AS MATERIALIZED (SELECT lang, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE cls = '{c}') AS c{c}" for c in E.CLASSES)} FROM cls GROUP BY 1),
{_draws_sql()},
drawn AS (SELECT *, lft AS d{E.CLASSES[-1]} FROM r{len(E.CLASSES) - 1}),
boot AS (SELECT CAST(rep AS INT) AS rep, {", ".join(f"CAST(sum({' + '.join('d' + x for x in E.CLASSES if x[0] + x[k] == v)}) AS BIGINT) AS {n}_{c}" for n, k in (("base", 1), ("candidate", 2)) for c, v in _CELLS.items())}
  FROM drawn GROUP BY 1),
diff AS (SELECT *, candidate_TP / (candidate_TP + candidate_FN)::DOUBLE - base_TP / (base_TP + base_FN)::DOUBLE AS ds,
   candidate_TN / (candidate_TN + candidate_FP)::DOUBLE - base_TN / (base_TN + base_FP)::DOUBLE AS dp FROM boot)"""


# Every unit of every replicate is drawn by itself.
UNIT_BOOT_SQL = I.EVALUATION_SQL + f""", u AS (
  SELECT lang, unit, truth::INT || '' || (selected::INT) || (d01 > 4 AND d21 > 2)::INT AS cls FROM evaluation WHERE eligible),
n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cls, unit) - 1 AS slot, count(*) OVER (PARTITION BY lang) AS n FROM u),
d AS (SELECT rep, b.cls FROM (SELECT r AS rep, lang, ('0x' || substr(sha256('boot|' || r || '|' || lang || '|' || slot), 1, 13))::BIGINT % n AS i
        FROM n, range({REPS}) x(r)) a JOIN n b ON a.lang = b.lang AND a.i = b.slot),
boot AS (SELECT CAST(rep AS INT) AS rep, {", ".join(f"CAST(count(*) FILTER (WHERE cls[1] || cls[{k}] = '{v}') AS BIGINT) AS {n}_{c}" for n, k in (("base", 2), ("candidate", 3)) for c, v in _CELLS.items())}
  FROM d GROUP BY 1),
diff AS (SELECT *, candidate_TP / (candidate_TP + candidate_FN)::DOUBLE - base_TP / (base_TP + base_FN)::DOUBLE AS ds,
   candidate_TN / (candidate_TN + candidate_FP)::DOUBLE - base_TN / (base_TN + base_FP)::DOUBLE AS dp FROM boot)"""


@query("paired_bootstrap", "D20", f"""
WITH {UNIT_BOOT_SQL} SELECT rep, {", ".join(f"{n}_{c}" for n in ("base", "candidate") for c in _CELLS)},
  round(ds, 6) AS d_sensitivity, round(dp, 6) AS d_specificity, round(-dp, 6) AS d_false_positive_rate, round((ds + dp) / 2, 6) AS d_balanced_accuracy FROM diff""")
def _(t):
    drawn = E.paired_unit_bootstrap(_rules(t), ["lang"], REPS, "boot", F.col("selected"), F.col("candidate"))
    return rounded(drawn, *E.DIFFERENCES)


def boot(t):
    return E.paired_bootstrap(_rules(t), ["lang"], REPS, "boot", F.col("selected"), F.col("candidate"))


@query("bootstrap_intervals", "D21", f"""
WITH {BOOT_SQL}, m AS (SELECT 'd_sensitivity' AS metric, ds AS x FROM diff UNION ALL SELECT 'd_specificity', dp FROM diff
  UNION ALL SELECT 'd_false_positive_rate', -dp FROM diff UNION ALL SELECT 'd_balanced_accuracy', (ds + dp) / 2 FROM diff)
SELECT metric, round(quantile_cont(x, 0.025), 6) AS lower, round(quantile_cont(x, 0.975), 6) AS upper FROM m GROUP BY 1""")
def _(t):
    return rounded(E.bootstrap_intervals(boot(t)), "lower", "upper")


@query("promotion_gate", "D21", f"""
WITH {BOOT_SQL}, i AS (SELECT quantile_cont(ds, 0.025) AS ls, quantile_cont(dp, 0.025) AS lp, quantile_cont((ds + dp) / 2, 0.025) AS lb FROM diff),
p AS (SELECT (count(*) FILTER (WHERE truth AND d01 > 4 AND d21 > 2) - count(*) FILTER (WHERE truth AND selected)) / count(*) FILTER (WHERE truth)::DOUBLE / 2
  + (count(*) FILTER (WHERE NOT truth AND NOT (d01 > 4 AND d21 > 2)) - count(*) FILTER (WHERE NOT truth AND NOT selected)) / count(*) FILTER (WHERE NOT truth)::DOUBLE / 2 AS gain
  FROM evaluation WHERE eligible)
SELECT gain >= 0.025 AS gain_ok, lb > 0 AS ba_ok, ls > -0.025 AS sensitivity_ok, lp > -0.025 AS specificity_ok,
  gain >= 0.025 AND lb > 0 AND ls > -0.025 AND lp > -0.025 AS promoted,
  CASE WHEN gain >= 0.025 AND lb > 0 AND ls > -0.025 AND lp > -0.025 THEN 4.0 ELSE 10.0 END::DOUBLE AS final_t01,
  CASE WHEN gain >= 0.025 AND lb > 0 AND ls > -0.025 AND lp > -0.025 THEN 2.0 ELSE 10.0 END::DOUBLE AS final_t21 FROM i, p""")
def _(t):
    rows = _rules(t)
    ba = lambda c: (F.count_if(F.col("truth") & F.col(c)) / F.count_if("truth")
                    + F.count_if(~F.col("truth") & ~F.col(c)) / F.count_if(~F.col("truth"))) / 2
    point = rows.agg((ba("candidate") - ba("selected")).alias("gain"), F.lit(4.0).alias("t01"), F.lit(2.0).alias("t21"))
    out = E.promotion_gate(E.bootstrap_intervals(boot(t)), point)
    return out.select("gain_ok", "ba_ok", "sensitivity_ok", "specificity_ok", "promoted", "final_t01", "final_t21")
