"""Queries on spectra: injection, periodograms, cutoffs, model grids, slopes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from evenkeel.operators import decisions as D
from evenkeel.operators import spectra as S
from evenkeel.session import materialize
from evenkeel.suite import inputs as I
from evenkeel.suite.decisions import rounded
from evenkeel.suite.registry import query

SEGMENT = 30


def stretch(t):
    """Every sample of every series, with its position; written once, because lengths and samples are read apart."""
    return materialize(I.series(t).select("series_id", "idx", F.col("idx").alias("pos"), "t", "y"))


STRETCH_SQL = I.SERIES_SQL + ", st AS (SELECT series_id, idx, t, y FROM series)"

UNIFORM = "('0x' || substr(sha256('{ns}|' || series_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"

PARAMS_SQL = f""", pa AS (SELECT series_id, dur AS duration, pt AS peak_t,
  exp(ln(40.0) + {UNIFORM.format(ns="demo:PERIOD")} * (ln(least(300.0, dur / 3)) - ln(40.0))) AS true_period,
  {UNIFORM.format(ns="demo:PHASE")} * {2.0 * math.pi!r} AS phase
  FROM (SELECT series_id, max(t) AS dur, round(0.2 * max(idx)) * 20.0::DOUBLE AS pt FROM st GROUP BY 1))"""


def params(t):
    d = stretch(t).groupBy("series_id").agg(F.max("t").alias("duration"), (F.round(0.2 * F.max("idx")) * 20.0).alias("peak_t"))
    return S.draw_parameters(d, "series_id", F.col("duration"), "demo")


@query("parameter_draws", "F8", f"""
WITH {STRETCH_SQL}{PARAMS_SQL}
SELECT series_id, round(true_period, 6) AS true_period, round(phase, 6) AS phase, round(duration / true_period, 6) AS cycles FROM pa""")
def _(t):
    return rounded(params(t).select("series_id", "true_period", "phase", "cycles"), "true_period", "phase", "cycles")


@query("signal_injection", "F7 F9", f"""
WITH {STRETCH_SQL}{PARAMS_SQL}, e AS (SELECT st.*, pa.* EXCLUDE series_id, CASE WHEN t <= peak_t THEN 0.5 * exp((t - peak_t) / (duration * 0.04))
   ELSE 0.5 * exp(-(t - peak_t) / (duration * 0.3)) END AS env FROM st JOIN pa USING (series_id))
SELECT series_id, idx, false AS signal, round(y + env, 6) AS y FROM e
UNION ALL SELECT series_id, idx, true, round(y + env + 0.04 * env * sin({2.0 * math.pi!r} * (t - peak_t) / true_period + phase), 6) FROM e""")
def _(t):
    return S.inject(stretch(t), params(t), "series_id", 0.04).select("series_id", "idx", "signal", F.round("y", 6).alias("y"))


POWER_SQL = STRETCH_SQL + f""", m AS (SELECT series_id, count(*) AS n, avg(y) AS m, (max(t) - min(t)) / (count(*) - 1) AS dt FROM st GROUP BY 1),
z AS (SELECT series_id, idx, n, dt, (y - m) / m * (0.5 - 0.5 * cos({2.0 * math.pi!r} * idx / (n - 1))) AS z FROM st JOIN m USING (series_id)),
pw AS (SELECT series_id, k, k / any_value(n * dt) AS freq, power(sum(z * cos({2.0 * math.pi!r} * ((k * idx) % n) / n)), 2) + power(sum(z * sin({2.0 * math.pi!r} * ((k * idx) % n) / n)), 2) AS power
  FROM z, range(1, 1 + (SELECT max(n) // 2 FROM m)) r(k) WHERE k <= (n - 1) // 2 GROUP BY 1, 2),
sp AS (SELECT series_id, k, freq, power / avg(power) OVER w / (stddev_pop(power) OVER w / avg(power) OVER w) AS power FROM pw WINDOW w AS (PARTITION BY series_id))"""


@query("periodogram", "F10", f"WITH {POWER_SQL} SELECT series_id, k, round(freq, 9) AS freq, round(power, 6) AS power FROM sp")
def _(t):
    return rounded(rounded(S.periodogram(stretch(t), ["series_id"]), "freq", digits=9), "power")


@query("frequency_cutoff", "F11", f"""
WITH {POWER_SQL} SELECT series_id, CAST(count(*) AS BIGINT) AS positive_bins, CAST(count(*) FILTER (WHERE freq < 0.02) AS BIGINT) AS kept_bins,
  round(min(freq) FILTER (WHERE freq < 0.02), 9) AS lowest, round(max(freq) FILTER (WHERE freq < 0.02), 9) AS highest FROM sp GROUP BY 1""")
def _(t):
    return rounded(S.bin_counts(S.periodogram(stretch(t), ["series_id"]), ["series_id"], 0.02), "lowest", "highest", digits=9)


POINTS = {"M0": (5, 4, 4), "M1": (3, 3, 3, 3, 4, 2), "M2": (4, 3, 4, 3, 3)}


def _axis(model: str) -> str:
    lists = [f"unnest([{', '.join(repr(v) for v in ax)}]::DOUBLE[])" for ax in S.axes(model, POINTS[model])]
    cols = [f"(SELECT {u} AS a{i}) x{i}" for i, u in enumerate(lists)]
    pad = ", ".join(f"0.0::DOUBLE AS a{i}" for i in range(len(lists), S.WIDTH))
    return f"SELECT '{model}' AS model, {', '.join(f'a{i}' for i in range(len(lists)))}{', ' + pad if pad else ''} FROM {', '.join(cols)}"


GRID_SQL = POWER_SQL + f""", grid AS ({" UNION ALL ".join(_axis(m) for m in POINTS)}),
c AS (SELECT series_id, freq, power, min(freq) OVER (PARTITION BY series_id) AS fmin FROM sp WHERE freq < 0.025),
ll AS (SELECT series_id, model, a0, a1, a2, a3, a4, a5, count(*) AS bins, -sum(ln(s)) - sum(power / s) AS lnl FROM (
  SELECT c.*, grid.*, CASE model WHEN 'M2' THEN CASE WHEN freq < a2 THEN exp(a0) * pow(freq, -a1) ELSE exp(a0) * pow(a2, -a1 + a3) * pow(freq, -a3) END + exp(a4)
    ELSE exp(a0) * pow(freq / fmin, -a1) + exp(a2) + CASE model WHEN 'M1' THEN exp(a3) / sqrt({2.0 * math.pi!r} * a5 * a5) * exp(-0.5 * pow((ln(freq) - a4) / a5, 2)) ELSE 0 END END AS s
  FROM c, grid) GROUP BY ALL)"""


@query("model_grid", "F12", f"""
WITH {GRID_SQL}
SELECT series_id, model, CAST(any_value(bins) AS BIGINT) AS bins, round(max(lnl), 4) AS lnl,
  round(-2 * max(lnl) + CASE model WHEN 'M0' THEN 2 WHEN 'M1' THEN 5 ELSE 4 END * ln(any_value(bins)), 4) AS bic FROM ll GROUP BY 1, 2""")
def _(t):
    sp = S.cut(S.periodogram(stretch(t), ["series_id"]))
    out = S.fit_grid(sp, ["series_id"], POINTS, refine=0)
    return rounded(out.select("series_id", "model", "bins", "lnl", "bic"), "lnl", "bic", digits=4)


def refined(t):
    sp = S.cut(S.periodogram(stretch(t), ["series_id"]))
    return S.fit_status(S.fit_grid(sp, ["series_id"], POINTS, refine=1))


def _clipped(i: int) -> str:
    """The moved parameter within the bounds of its model."""
    out = "0.0"
    for model, bounds in S.BOUNDS.items():
        if i < len(bounds):
            lo, hi = bounds[i]
            x = f"(b.a{i} + o.a{i})"
            x = x if lo is None else f"greatest({x}, {lo!r})"
            x = x if hi is None else f"least({x}, {hi!r})"
            out = f"CASE WHEN o.model = '{model}' THEN {x} ELSE {out} END"
    return f"{out} AS a{i}"


def _steps(model: str) -> str:
    """Offsets of the local grid: half a spacing down, none, up, in every parameter."""
    widths = [(ax[-1] - ax[0]) / max(len(ax) - 1, 1) * 0.5 for ax in S.axes(model, POINTS[model])]
    cols = [f"(SELECT unnest([{-w!r}, 0.0, {w!r}]::DOUBLE[]) AS a{i}) x{i}" for i, w in enumerate(widths)]
    pad = ", ".join(f"0.0::DOUBLE AS a{i}" for i in range(len(widths), S.WIDTH))
    return f"SELECT '{model}' AS model, {', '.join(f'a{i}' for i in range(len(widths)))}{', ' + pad if pad else ''} FROM {', '.join(cols)}"


MODEL_SQL = f"""CASE model WHEN 'M2' THEN CASE WHEN freq < a2 THEN exp(a0) * pow(freq, -a1) ELSE exp(a0) * pow(a2, -a1 + a3) * pow(freq, -a3) END + exp(a4)
  ELSE exp(a0) * pow(freq / fmin, -a1) + exp(a2) + CASE model WHEN 'M1' THEN exp(a3) / sqrt({2.0 * math.pi!r} * a5 * a5) * exp(-0.5 * pow((ln(freq) - a4) / a5, 2)) ELSE 0 END END"""

PICK = "row_number() OVER (PARTITION BY series_id, model ORDER BY round(lnl, 6) DESC, a0, a1, a2, a3, a4, a5) = 1"

HIT_SQL = "(" + " + ".join(f"CASE WHEN model = '{m}' AND abs(a{i} - ({edge!r})) <= 1e-7 THEN 1 ELSE 0 END"
                           for m, bounds in S.BOUNDS.items() for i, pair in enumerate(bounds) for edge in pair if edge is not None) + ")"

REFINED_SQL = GRID_SQL + f""", b AS MATERIALIZED (SELECT * FROM ll QUALIFY {PICK}),
o AS MATERIALIZED ({" UNION ALL ".join(_steps(m) for m in POINTS)}),
near AS MATERIALIZED (SELECT DISTINCT b.series_id, o.model, {", ".join(_clipped(i) for i in range(S.WIDTH))} FROM b JOIN o USING (model)),
l2 AS MATERIALIZED (SELECT series_id, model, a0, a1, a2, a3, a4, a5, count(*) AS bins, -sum(ln(s)) - sum(power / s) AS lnl FROM (
  SELECT near.*, power, {MODEL_SQL} AS s FROM near JOIN c USING (series_id)) GROUP BY ALL),
ends AS (SELECT series_id, model, count(*) FILTER (WHERE NOT s > 0) AS non_positive, count(*) FILTER (WHERE NOT isfinite(s)) AS overflow FROM (
  SELECT series_id, model, {MODEL_SQL} AS s FROM (SELECT series_id, min(freq) AS fmin, unnest([min(freq), max(freq)]) AS freq FROM c GROUP BY 1), grid) GROUP BY 1, 2),
t AS (SELECT series_id, model, count(*) AS ties FROM (SELECT *, max(round(lnl, 6)) OVER (PARTITION BY series_id, model) AS top FROM l2) WHERE round(lnl, 6) = top GROUP BY 1, 2),
fits AS MATERIALIZED (SELECT *, -2 * lnl + CASE model WHEN 'M0' THEN 2 WHEN 'M1' THEN 5 ELSE 4 END * ln(bins) AS bic, {HIT_SQL} AS hits,
    (non_positive > 0)::INT + (overflow > 0)::INT + (ties > 1)::INT AS warning_count,
    list_filter([CASE WHEN non_positive > 0 THEN 'NonPositiveModel: ' || non_positive || ' model values at the ends of the range' END,
      CASE WHEN overflow > 0 THEN 'Overflow: ' || overflow || ' model values at the ends of the range' END, CASE WHEN ties > 1 THEN 'TieOfBestPoints: ' || ties || ' parameter rows' END], lambda x: x IS NOT NULL) AS texts
  FROM (SELECT * FROM l2 QUALIFY {PICK}) JOIN ends USING (series_id, model) JOIN t USING (series_id, model))"""


@query("refined_fits", "F12 F13 B13 B14 B15", f"""
WITH {REFINED_SQL}
SELECT series_id, model, 'OK' AS status, round(lnl, 4) AS lnl, round(bic, 4) AS bic, hits > 0 AS at_bound, hits AS n_hits, CASE WHEN model = 'M1' THEN round(1 / exp(a4), 4) END AS period,
  ties, warning_count, '[' || array_to_string(list_transform(texts, lambda x: '"' || x || '"'), ',') || ']' AS warning_types FROM fits""")
def _(t):
    return rounded(refined(t).select("series_id", "model", "status", "lnl", "bic", "at_bound", F.size("bound_hits").alias("n_hits"), "period", "ties", "warning_count",
                                     "warning_types"), "lnl", "bic", "period", digits=4)


@query("spectral_decisions", "D1 F12 F13", f"""
WITH {REFINED_SQL}, w AS (SELECT series_id, max(bic) FILTER (WHERE model = 'M0') AS b0, max(bic) FILTER (WHERE model = 'M1') AS b1, max(bic) FILTER (WHERE model = 'M2') AS b2,
  CAST(sum(warning_count) AS BIGINT) AS warnings FROM fits GROUP BY 1)
SELECT series_id, round(b0 - b1, 4) AS d01, round(b2 - b1, 4) AS d21, b0 - b1 > 10 AND b2 - b1 > 10 AS selected, 'VALID' AS decision_status, warnings FROM w""")
def _(t):
    rows = S.score_table(refined(t), ["series_id"])
    out = D.assemble_trios(rows, ["series_id"], mode="skip", ok=F.col("status") == "OK", carry=["warning_count"])
    warnings = sum((F.col(f"warning_count_m{i}") for i in range(3)), F.lit(0)).cast("bigint")
    return out.select("series_id", F.round("d01", 4).alias("d01"), F.round("d21", 4).alias("d21"), "selected", "decision_status", warnings.alias("warnings"))


PIECES_SQL = I.SERIES_SQL + """, sized AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM series),
st AS (SELECT series_id, y, idx // 30 AS seg, idx % 30 AS pos FROM sized WHERE idx // 30 < n // 30
  UNION ALL SELECT series_id, y, n // 30, idx - (n - 30) FROM sized WHERE n >= 30 AND n % 30 > 0 AND idx >= n - 30)"""


@query("ensemble_slope", "D22", f"""
WITH {PIECES_SQL},
m AS (SELECT series_id, seg, avg(y) AS m FROM st GROUP BY 1, 2),
pw AS (SELECT series_id, seg, k, k / 600.0::DOUBLE AS freq, power(sum((y - m) / m * cos({2.0 * math.pi!r} * ((k * pos) % 30) / 30)), 2) + power(sum((y - m) / m * sin({2.0 * math.pi!r} * ((k * pos) % 30) / 30)), 2) AS p
  FROM st JOIN m USING (series_id, seg), range(1, 16) r(k) GROUP BY 1, 2, 3),
e AS (SELECT series_id % 2 AS grp, (series_id % 3)::DOUBLE AS level, freq, avg(p) AS p FROM pw GROUP BY 1, 2, 3),
s AS (SELECT grp, level, CAST(count(*) AS BIGINT) AS bins, regr_slope(ln(p), ln(freq)) AS slope FROM e GROUP BY 1, 2),
o AS (SELECT grp, coalesce(bool_and(b > slope) FILTER (WHERE b IS NOT NULL), true) AS ordered FROM (SELECT *, lag(slope) OVER (PARTITION BY grp ORDER BY level) AS b FROM s) GROUP BY 1)
SELECT s.grp, level, bins, round(slope, 6) AS slope, round(abs(slope + level), 6) AS error, ordered, abs(slope + level) <= 0.35 AS within_tolerance
FROM s JOIN o USING (grp)""")
def _(t):
    pieces, _ = S.equal_pieces(I.series(t), ["series_id"], SEGMENT)
    sp = S.power_spectrum(pieces, ["series_id", "piece"], hann=False, nyquist=True)
    sp = sp.withColumns({"grp": F.col("series_id") % 2, "level": (F.col("series_id") % 3).cast("double"), "freq": F.round("freq", 12)})
    return rounded(S.ensemble_slope(sp, ["grp"], "level"), "slope", "error")


@query("short_realisations", "D22 E3", f"""
WITH {I.SERIES_SQL}
SELECT 'series_shorter_than_piece' AS rule, series_id::VARCHAR AS key, count(*)::VARCHAR AS detail FROM series GROUP BY series_id HAVING count(*) < 70""")
def _(t):
    return S.equal_pieces(I.series(t), ["series_id"], 70)[1]
