"""Known-truth evaluation: confusion, rates, selection function, period recovery, bootstrap, gate."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from evenkeel.functions import labels as L
from evenkeel.functions.numeric import hash_index, hash_uniform, is_finite, period_errors, safe_ratio, wilson
from evenkeel.operators.ordered import grouped, quantiles
from evenkeel.session import spread

# Period bins, the label of an empty stratum, and the promotion criteria.
PERIOD_EDGES = (40.0, 63.245553203367585, 105.83005244258362, 300.0)
PERIOD_BINS = ("P40_63", "P63_106", "P106_300")
NO_EXPOSURE = "STRUCTURAL_NO_EXPOSURE"
MIN_GAIN = 0.025
MAX_LOSS = -0.025


def confusion(df: DataFrame, by: Sequence[str] = (), eligible: Column | None = None) -> DataFrame:
    """TP, FN, TN, FP over admissible rows with a decision; an inadmissible input is never a negative."""
    ok = F.col("selected").isNotNull() & F.col("truth").isNotNull()
    if eligible is not None:
        ok = ok & eligible
    label = L.confusion_label(F.col("truth"), F.col("selected"))
    return df.where(ok).groupBy(*by).agg(*[F.count_if(label == c).alias(c) for c in ("TP", "FN", "TN", "FP")])


def _tall(df: DataFrame, by: Sequence[str], name: str, parts: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Unpivot (numerator, denominator) pairs and add rate and Wilson bounds."""
    rows = F.array(*[F.struct(F.lit(m).alias(name), k.cast("bigint").alias("numerator"),
                              n.cast("bigint").alias("denominator")) for m, (k, n) in parts.items()])
    out = df.select(*by, F.explode(rows).alias("_s")).select(*by, "_s.*")
    k, n = F.col("numerator"), F.col("denominator")
    lo, hi = wilson(k, n)
    return out.withColumns({"rate": safe_ratio(k, n), "lower": lo, "upper": hi})


def rates(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sensitivity, specificity and false-positive rate with intervals, and balanced accuracy per group."""
    tp, fn, tn, fp = (F.col(c) for c in ("TP", "FN", "TN", "FP"))
    out = _tall(conf, by, "metric", {"sensitivity": (tp, tp + fn), "specificity": (tn, tn + fp),
                                     "false_positive_rate": (fp, fp + tn)})
    ba = (safe_ratio(tp, tp + fn) + safe_ratio(tn, tn + fp)) / 2
    none = F.lit(None)
    balanced = conf.select(*by, F.lit("balanced_accuracy").alias("metric"), none.cast("bigint").alias("numerator"),
                           none.cast("bigint").alias("denominator"), ba.alias("rate"),
                           none.cast("double").alias("lower"), none.cast("double").alias("upper"))
    return out.unionByName(balanced)


def end_to_end(df: DataFrame, plane: str, primary: str) -> DataFrame:
    """Admissibility, positive recovery and null selection over all planned rows, on three scopes."""
    scope = F.explode(F.array(F.when(F.col(plane) == primary, "PRIMARY").otherwise("CHALLENGE"), F.lit("ALL")))
    hit = F.col("eligible") & F.coalesce(F.col("selected"), F.lit(False))
    g = df.withColumn("scope", scope).groupBy("scope").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("eligible").alias("_e"),
        F.count_if("truth").alias("_p"), F.count_if(F.col("truth") & hit).alias("_ps"),
        F.count_if(~F.col("truth")).alias("_z"), F.count_if(~F.col("truth") & hit).alias("_zs"))
    c = F.col
    return _tall(g, ["scope"], "metric", {
        "input_admissibility_fraction": (c("_e"), c("_n")),
        "end_to_end_positive_recovery_fraction": (c("_ps"), c("_p")),
        "end_to_end_null_selection_fraction": (c("_zs"), c("_z"))})


def _strata_counts(df: DataFrame, strata: Sequence[str], pooled: Sequence[str], bin_column: str) -> DataFrame:
    """(kind, *strata, bin, _n, _e, _s): rows, eligible and selected ones of every stratum found."""
    key = lambda kind, cols, b: F.struct(
        F.lit(kind).alias("kind"), *[(F.col(c) if c in cols else F.lit("ALL")).alias(c) for c in strata],
        b.alias(bin_column))
    spots = F.explode(F.when(F.col("truth"), F.array(
        key("POSITIVE", strata, F.lit("ALL")), key("POSITIVE_BY_PERIOD", strata, F.coalesce(F.col(bin_column), F.lit("NONE")))))
        .otherwise(F.array(key("NULL_POOLED", pooled, F.lit("ALL")))))
    hit = F.col("eligible") & F.coalesce(F.col("selected"), F.lit(False))
    return df.select(spots.alias("_k"), "eligible", hit.alias("_hit")).groupBy("_k").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("eligible").alias("_e"), F.count_if("_hit").alias("_s")).select(
        "_k.*", "_n", "_e", "_s")


def selection_function(df: DataFrame, grid: DataFrame, strata: Sequence[str], pooled: Sequence[str],
                       bin_column: str) -> DataFrame:
    """Eligibility, conditional and end-to-end selection per stratum, with declared empty strata.

    Positives count in their base stratum and in their period-bin stratum, nulls in a stratum
    over ``pooled`` only. ``grid(kind, *strata, bin)`` declares every stratum of the design.
    """
    keys = ["kind", *strata, bin_column]
    got = _strata_counts(df, strata, pooled, bin_column)
    full = grid.select(*keys).join(got, keys, "left").na.fill(0, ["_n", "_e", "_s"])
    c = F.col
    out = _tall(full, keys, "function", {"input_eligibility": (c("_e"), c("_n")),
                                         "conditional_selection": (c("_s"), c("_e")),
                                         "end_to_end_selection": (c("_s"), c("_n"))})
    return out.withColumn("status", F.when(F.col("denominator") == 0, NO_EXPOSURE).otherwise("ESTIMATED"))


def undeclared_strata(df: DataFrame, grid: DataFrame, strata: Sequence[str], pooled: Sequence[str],
                      bin_column: str) -> DataFrame:
    """Violations: strata of :func:`selection_function` that have rows but are not in ``grid``, with their number of rows."""
    keys = ["kind", *strata, bin_column]
    found = _strata_counts(df, strata, pooled, bin_column).join(grid.select(*keys), keys, "left_anti")
    return found.select(
        F.lit("undeclared_stratum").alias("rule"), F.concat_ws("|", *[F.coalesce(k, F.lit("NULL")) for k in keys]).alias("key"),
        F.concat(F.col("_n").cast("string"), F.lit(" rows")).alias("detail"))


def period_recovery(df: DataFrame, by: Sequence[str] = (), estimate: str = "estimate", truth: str = "true_period",
                    support: tuple[float, float] = (PERIOD_EDGES[0], PERIOD_EDGES[-1]),
                    group_rows: int | None = None) -> DataFrame:
    """Coverage over all eligible positives, and error quantiles over recovered ones only.

    A period counts as recovered for a selected positive with a finite estimate inside the
    support; the estimate of a non-selected row is never used.
    """
    pop = df.where(F.col("truth") & F.col("eligible"))
    ok = (F.coalesce(F.col("selected"), F.lit(False)) & is_finite(F.col(estimate))
          & F.col(estimate).between(*support))
    pop = pop.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    err = {k: F.when(F.col("_ok"), v) for k, v in period_errors(F.col(estimate), F.col(truth)).items()
           if k in ("absolute_error", "relative_error", "log_ratio")}
    out = grouped(pop, by, [F.count(F.lit(1)).alias("eligible_positives"), F.count_if("_ok").alias("recovered")],
                  err, (0.16, 0.5, 0.84), group_rows)
    out = out.withColumns({"missing": F.col("eligible_positives") - F.col("recovered"),
                           "coverage": safe_ratio(F.col("recovered"), F.col("eligible_positives"))})
    return out.select(*by, "eligible_positives", "recovered", "missing", "coverage", *[F.try_element_at(e, F.lit(i + 1)).alias(f"{e}_{p}")
                                    for e in err for i, p in enumerate(("p16", "p50", "p84"))])


def pair_members(df: DataFrame, unit: str, role: str, positive: str, null: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Positive and null member of each background unit side by side, and units that lack either.

    One grouping on the unit replaces a self-join.
    """
    side = lambda r, c: F.max(F.when(F.col(role) == r, F.col(c)))
    g = df.groupBy(unit).agg(
        *[side(positive, c).alias(f"positive_{c}") for c in columns], *[side(null, c).alias(f"null_{c}") for c in columns],
        F.count_if(F.col(role) == positive).alias("_p"), F.count_if(F.col(role) == null).alias("_z"))
    paired = (F.col("_p") == 1) & (F.col("_z") == 1)
    bad = g.where(~paired).select(F.lit("unpaired_background").alias("rule"), F.col(unit).cast("string").alias("key"),
                                  F.concat_ws("|", "_p", "_z").alias("detail"))
    return g.where(paired).drop("_p", "_z"), bad


COUNTS = ("TP", "FN", "TN", "FP")


CLASSES = tuple(f"{t}{b}{c}" for t in "01" for b in "01" for c in "01")
DRAW_BLOCK = 256


def binomial_quantile(u: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Least ``k`` whose cumulative binomial probability reaches ``u``.

    Probabilities are taken relative to their sum from ten deviations below the mean to ten above (beyond which less than
    1e-16 lies), each from the one before it, so that no rounding of a first term shifts the far tail.
    """
    n, mean = n.astype(float), n * p
    reach = 10.0 * np.sqrt(mean * (1.0 - p)) + 10.0
    low, high = np.maximum(0.0, np.floor(mean - reach)), np.minimum(n, np.ceil(mean + reach))
    inner = (p > 0) & (p < 1) & (n > 0)
    odds = np.where(inner, p, 0.5) / (1.0 - np.where(inner, p, 0.5))

    def walk(stop_at: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        k, mass, total = low.copy(), np.ones(len(n)), np.ones(len(n))
        while True:
            going = inner & (k < high)
            if stop_at is not None:
                going &= total < stop_at
            if not going.any():
                return k, total
            mass = np.where(going, mass * ((n - k) / (k + 1.0) * odds), mass)
            k = np.where(going, k + 1.0, k)
            total = np.where(going, total + mass, total)

    k, _ = walk(u * walk(None)[1])
    return np.where(inner, k, mean).astype(np.int64)


def _draw_classes(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How often each class is drawn: a multinomial draw as binomials, each of what the classes before it have left."""
    n = len(CLASSES)
    schema = StructType([rows.schema[k] for k in keys] + [StructField(f"d{c}", LongType()) for c in CLASSES])
    from pyspark.sql.pandas.types import to_arrow_schema
    wanted = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.asarray([batch.column(f"c{c}").to_numpy() for c in CLASSES])
            left, rest, drawn = counts.sum(axis=0), counts.sum(axis=0), []
            for i in range(n - 1):
                share = np.where(rest > 0, counts[i] / np.maximum(rest, 1), 0.0)
                drawn.append(binomial_quantile(batch.column(f"u{i}").to_numpy(), left, share))
                left, rest = left - drawn[-1], rest - counts[i]
            drawn.append(left)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *[pa.array(d) for d in drawn]], schema=wanted)

    return rows.mapInArrow(run, schema)


def paired_bootstrap(df: DataFrame, strata: Sequence[str], reps: int, seed: str, base: Column, candidate: Column) -> DataFrame:
    """Stratified paired bootstrap of two rules on the same units.

    Drawing the units of a stratum with replacement draws their outcome classes (truth, base, candidate) from its eight class
    counts, so a replicate of a stratum is one multinomial draw: seven binomials, inverted from uniform numbers that are hashes
    of seed, replicate, stratum and class. The units are counted once; nothing else grows with them.
    """
    kind = _outcome_class(base, candidate)
    counts = df.groupBy(*strata).agg(*[F.count_if(kind == c).alias(f"c{c}") for c in CLASSES])
    rows = counts.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    text = [F.col(c).cast("string") for c in strata]
    draw = lambda i: hash_uniform(F.lit(seed), F.col("rep").cast("string"), *text, F.lit(CLASSES[i]))
    rows = spread(rows, *strata, "rep").withColumns({f"u{i}": draw(i) for i in range(len(CLASSES) - 1)})
    drawn = _draw_classes(rows, ["rep"])
    got = drawn.groupBy("rep").agg(*[
        F.sum(sum((F.col(f"d{k}") for k in CLASSES if _cell(k, rule) == cell), F.lit(0))).alias(f"{name}_{cell}")
        for name, rule in (("base", 1), ("candidate", 2)) for cell in COUNTS])
    return _differences(got)


def paired_unit_bootstrap(df: DataFrame, strata: Sequence[str], reps: int, seed: str, base: Column, candidate: Column) -> DataFrame:
    """Stratified paired bootstrap of two rules that draws every unit of every replicate by itself.

    A stratum of n units has n draws a replicate, each an index below n hashed from seed, replicate, stratum and draw. Units stand in
    order of their outcome class, so the class of an index follows from the class counts and a draw needs no join to the units.
    Draws are multiplied inside tasks and counted map-side; what is shuffled is one row of counters per replicate and task.
    """
    kind = _outcome_class(base, candidate)
    counts = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(kind <= c).alias(f"_e{c}") for c in CLASSES])
    # A block of draws is a row of its own, so that one large stratum is drawn by many tasks.
    blocks = counts.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(DRAW_BLOCK).cast("bigint"))))
    slots = spread(blocks, *strata, "_from").withColumn(
        "_slot", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (DRAW_BLOCK - 1), F.col("_n") - 1))))
    draws = slots.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    text = [F.col(c).cast("string") for c in strata]
    at = hash_index(F.col("_n"), F.lit(seed), F.col("rep").cast("string"), *text, F.col("_slot").cast("string"))
    label = F.lit(CLASSES[-1])
    for c in reversed(CLASSES[:-1]):
        label = F.when(F.col("_i") < F.col(f"_e{c}"), c).otherwise(label)
    drawn = draws.withColumn("_i", at).select("rep", label.alias("_d"))
    got = drawn.groupBy("rep").agg(*[F.count_if(F.col("_d") == c).alias(f"d{c}") for c in CLASSES])
    return _differences(got.select("rep", *[
        sum((F.col(f"d{k}") for k in CLASSES if _cell(k, rule) == cell), F.lit(0)).cast("bigint").alias(f"{name}_{cell}")
        for name, rule in (("base", 1), ("candidate", 2)) for cell in COUNTS]))


def _outcome_class(base: Column, candidate: Column) -> Column:
    flag = lambda x: F.when(F.coalesce(x, F.lit(False)), "1").otherwise("0")
    return F.concat(flag(F.col("truth")), flag(base), flag(candidate))


def _differences(got: DataFrame) -> DataFrame:
    sens = lambda n: safe_ratio(F.col(f"{n}_TP"), F.col(f"{n}_TP") + F.col(f"{n}_FN"))
    spec = lambda n: safe_ratio(F.col(f"{n}_TN"), F.col(f"{n}_TN") + F.col(f"{n}_FP"))
    ds, dp = sens("candidate") - sens("base"), spec("candidate") - spec("base")
    return got.withColumns({"d_sensitivity": ds, "d_specificity": dp, "d_false_positive_rate": -dp,
                            "d_balanced_accuracy": (ds + dp) / 2})


def _cell(key: str, rule: int) -> str:
    """Confusion cell of an outcome class for the base (1) or candidate (2) rule."""
    return {"11": "TP", "10": "FN", "01": "FP", "00": "TN"}[key[0] + key[rule]]


DIFFERENCES = ("d_sensitivity", "d_specificity", "d_false_positive_rate", "d_balanced_accuracy")


def bootstrap_intervals(boot: DataFrame, level: float = 0.95) -> DataFrame:
    """Two-sided percentile interval of every difference; one row per metric."""
    a = (1 - level) / 2
    q = quantiles(boot, [], {c: F.col(c) for c in DIFFERENCES}, (a, 1 - a))
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.try_element_at(c, F.lit(1)).alias("lower"),
                              F.try_element_at(c, F.lit(2)).alias("upper")) for c in DIFFERENCES])
    return q.select(F.explode(rows).alias("_s")).select("_s.*")


def promotion_gate(intervals: DataFrame, point: DataFrame) -> DataFrame:
    """Promote the candidate only if all four criteria hold; otherwise the baseline rule stays.

    ``point`` has one row with ``gain``, ``t01``, ``t21``; thresholds of 10 are the baseline.
    """
    low = lambda m: F.max(F.when(F.col("metric") == m, F.col("lower")))
    i = intervals.agg(low("d_balanced_accuracy").alias("lower_ba"), low("d_sensitivity").alias("lower_sens"),
                      low("d_specificity").alias("lower_spec"))
    row = point.crossJoin(F.broadcast(i))  # both sides are single-row aggregates
    crit = {"gain_ok": F.col("gain") >= MIN_GAIN, "ba_ok": F.col("lower_ba") > 0,
            "sensitivity_ok": F.col("lower_sens") > MAX_LOSS, "specificity_ok": F.col("lower_spec") > MAX_LOSS}
    out = row.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in crit.items()})
    every = F.col("gain_ok") & F.col("ba_ok") & F.col("sensitivity_ok") & F.col("specificity_ok")
    return out.withColumns({"promoted": every,
                            "final_t01": F.when(every, F.col("t01")).otherwise(10.0),
                            "final_t21": F.when(every, F.col("t21")).otherwise(10.0)})
