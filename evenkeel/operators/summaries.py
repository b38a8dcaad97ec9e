"""Summaries with explicit numerators, denominators and zero rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions import labels as L
from evenkeel.functions.numeric import finite_or_null, is_finite, payload_text, safe_ratio, wilson
from evenkeel.operators.ordered import grouped

SIX = (0.25, 0.5, 0.75)


def rate_summary(df: DataFrame, by: Sequence[str], flag: Column, clamp: bool = True,
                 on_empty: str = "null") -> DataFrame:
    """Valid and selected counts, rate and Wilson bounds per group; NULL flags are not valid."""
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_planned"),
        F.count_if(flag.isNotNull()).alias("n_valid"),
        F.count_if(F.coalesce(flag, F.lit(False))).alias("n_selected"),
    )
    k, n = F.col("n_selected"), F.col("n_valid")
    lo, hi = wilson(k, n, clamp, on_empty)
    return out.withColumns({"rate": safe_ratio(k, n), "rate_lower": lo, "rate_upper": hi})


def attach(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe join of two summaries that share their group columns."""
    if not by:
        return left.join(F.broadcast(right), F.lit(True), how)  # both have one row
    l, r = left.alias("l"), right.alias("r")
    cond = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by])
    rest = [F.col(f"r.{c}").alias(c) for c in right.columns if c not in by]
    return l.join(r, cond, how).select("l.*", *rest)


def six_numbers(df: DataFrame, by: Sequence[str], values: Mapping[str, Column], group_rows: int | None = None) -> DataFrame:
    """n, min, q1, median, q3, max of the finite values, one row per group and quantity."""
    flat = df.select(*by, *[finite_or_null(c.cast("double")).alias(a) for a, c in values.items()])
    ends = [F.struct(F.count(a).alias("n"), F.min(a).alias("min"), F.max(a).alias("max")).alias(f"_e_{a}") for a in values]
    both = grouped(flat, by, ends, {a: F.col(a) for a in values}, SIX, group_rows)
    rows = F.explode(F.array(*[
        F.struct(F.lit(a).alias("quantity"), F.col(f"_e_{a}.n").alias("n"), F.col(f"_e_{a}.min").alias("min"),
                 F.try_element_at(a, F.lit(1)).alias("q1"), F.try_element_at(a, F.lit(2)).alias("median"),
                 F.try_element_at(a, F.lit(3)).alias("q3"), F.col(f"_e_{a}.max").alias("max"))
        for a in values]))
    return both.select(*by, rows.alias("_s")).select(*by, "_s.*")


def spread(df: DataFrame, by: Sequence[str], value: Column, group_rows: int | None = None) -> DataFrame:
    """Median, p10, p90, p16, p84 and range of the finite values."""
    probs = (0.5, 0.1, 0.9, 0.16, 0.84)
    flat = df.select(*by, finite_or_null(value.cast("double")).alias("_x"))
    ends = [F.count("_x").alias("n"), (F.max("_x") - F.min("_x")).alias("range")]
    both = grouped(flat, by, ends, {"_q": F.col("_x")}, probs, group_rows)
    names = ("median", "p10", "p90", "p16", "p84")
    return both.select(*by, "n", "range",
                       *[F.try_element_at("_q", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def condition_summary(df: DataFrame, by: Sequence[str], group_rows: int | None = None) -> DataFrame:
    """Rate with interval, error quantiles for selected and for all, bound and warning rates.

    Needs ``selected``, ``error``, ``d01``, ``d21`` and the counters ``bound_hits``, ``warnings``.
    """
    sel = F.col("selected")
    valid = sel.isNotNull()
    counts = [
        F.count(F.lit(1)).alias("n_planned"), F.count_if(valid).alias("n_valid"),
        F.count_if(F.coalesce(sel, F.lit(False))).alias("n_selected"),
        F.count_if(valid & (F.col("bound_hits") > 0)).alias("_bound"), F.count_if(F.col("warnings") > 0).alias("_warn"),
    ]
    out = grouped(df, by, counts, {
        "_sel_signed": F.when(sel, F.col("error")), "_sel_abs": F.when(sel, F.abs("error")),
        "_all_abs": F.when(valid, F.abs("error")), "_d01": F.when(valid, F.col("d01")),
        "_dmin": F.when(valid, F.least("d01", "d21")),
    }, (0.5, 0.9), group_rows)
    pick = lambda c, i: F.try_element_at(c, F.lit(i))
    k, n = F.col("n_selected"), F.col("n_valid")
    lo, hi = wilson(k, n)
    return out.select(
        *by, "n_planned", "n_valid", "n_selected",
        safe_ratio(k, n).alias("rate"), lo.alias("rate_lower"), hi.alias("rate_upper"),
        safe_ratio(F.col("_bound"), n).alias("bound_hit_rate"), safe_ratio(F.col("_warn"), F.col("n_planned")).alias("warning_rate"),
        pick("_sel_signed", 1).alias("selected_median_error"), pick("_sel_abs", 1).alias("selected_median_abs_error"),
        pick("_sel_abs", 2).alias("selected_p90_abs_error"), pick("_all_abs", 1).alias("formal_median_abs_error"),
        pick("_all_abs", 2).alias("formal_p90_abs_error"), pick("_d01", 1).alias("median_d01"), pick("_dmin", 1).alias("median_d_min"))


def model_diagnostics(fits: DataFrame, sets: Sequence[Sequence[str]], columns: Sequence[str],
                      group_rows: int | None = None) -> DataFrame:
    """Call, warning and bound counts per model for several groupings in one pass.

    ``sets`` lists the groupings over ``columns``; the ``scope`` column names the columns used.
    """
    cols = [F.col(c) for c in columns]
    scope = F.concat_ws("|", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns])
    agg = fits.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(
        scope.alias("scope"),
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("status") == "OK").alias("ok_calls"),
        F.count_if(F.col("warnings") > 0).alias("warning_calls"),
        F.sum("warnings").cast("bigint").alias("warning_total"),
        F.count_if(F.col("bound_hits") > 0).alias("bound_calls"),
        F.sum("runtime").alias("runtime_total"),
    )
    return agg.withColumns({"warning_rate": safe_ratio(F.col("warning_calls"), F.col("calls")),
                            "bound_hit_rate": safe_ratio(F.col("bound_calls"), F.col("calls"))})


def status_counts(df: DataFrame, by: Sequence[str], column: str, name: str = "status_counts") -> DataFrame:
    """``{"value":count}`` text per group, keys in order; two-level so that counting is map-side."""
    flat = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(column).cast("string").alias("k"), F.col("_n").alias("v"))))
    return flat.groupBy(*by).agg(F.to_json(F.map_from_entries(pairs)).alias(name))


def seed_stability(decisions: DataFrame, by: Sequence[str], seed: str = "seed") -> DataFrame:
    """How far the decision of one series depends on the seed.

    Reports both discordance measures (pairs, and against the lowest seed), score ranges and
    the set of states. Needs ``selected``, ``bic_*``, ``d01``, ``d21``.
    """
    n, k = F.col("n_seeds"), F.col("n_selected")
    sel = F.col("selected")
    rng = lambda c: (F.max(c) - F.min(c)).alias(f"{c}_range")
    first = F.min_by(sel, F.col(seed))
    out = decisions.where(sel.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_seeds"), F.count_if(sel).alias("n_selected"),
        first.alias("seed0_selected"),
        *[rng(c) for c in ("bic_m0", "bic_m1", "bic_m2", "d01", "d21")],
        *[F.countDistinct(c).alias(f"distinct_{c}") for c in ("bic_m0", "bic_m1", "bic_m2")],
        L.joined(F.collect_set(F.when(sel, "SELECTED").otherwise("NOT_SELECTED"))).alias("state_set"),
    )
    changed = F.when(F.col("seed0_selected"), n - k).otherwise(k)
    return out.withColumns({
        "pair_discordance": F.when(n >= 2, 2.0 * k * (n - k) / (n * (n - 1))),
        "discordant_vs_seed0": changed,
        "discordant_fraction": changed / n,
        "any_change": (k > 0) & (k < n),
    })


def seed_payloads(fits: DataFrame, by: Sequence[str], models: Sequence[str] = ("M0", "M1", "M2"), parameters: str = "parameters") -> DataFrame:
    """Per group and model: distinct parameter payloads, fits with warnings, fits on a bound; and the set of states.

    ``fits(by, model, parameters, warnings, bound_hits, status)``. Payloads are told apart by 128 bits of their canonical text.
    Equal payloads are counted within tasks and met under (group, model, payload), so the fits of one large group are spread over
    its payloads; a group then has as many rows as distinct payloads and only counters meet.
    """
    digest = F.md5(payload_text(F.col(parameters), fits.schema[parameters].dataType))
    per = fits.groupBy(*by, "model", digest.alias("_p")).agg(
        F.count_if(F.col("warnings") > 0).alias("_w"), F.sum("warnings").alias("_t"), F.count_if(F.col("bound_hits") > 0).alias("_b"),
        F.collect_set("status").alias("_s"))
    of = lambda m, c: F.coalesce(F.sum(F.when(F.col("model") == m, c)), F.lit(0).cast("bigint")).cast("bigint")
    out = [F.count_if(F.col("model") == m).alias(f"unique_parameter_payloads_{m.lower()}") for m in models]
    for name, c in (("warning_calls", "_w"), ("warning_count", "_t"), ("bound_calls", "_b")):
        out += [of(m, F.col(c)).alias(f"{name}_{m.lower()}") for m in models]
    states = F.array_distinct(F.flatten(F.collect_set("_s")))
    return per.groupBy(*by).agg(*out, L.joined(states).alias("status_set"))


def seed_diagnostics(payloads: DataFrame, calls: DataFrame, models: Sequence[str] = ("M0", "M1", "M2")) -> DataFrame:
    """Per model over all groups: calls, warnings, bounds, states, and a six-number summary of distinct payloads.

    ``payloads`` from :func:`seed_payloads`, ``calls`` the fits it was made of.
    """
    tall = payloads.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"unique_parameter_payloads_{m.lower()}").alias("unique_payloads"),
                 F.col(f"warning_calls_{m.lower()}").alias("warning_calls"), F.col(f"warning_count_{m.lower()}").alias("warning_count"),
                 F.col(f"bound_calls_{m.lower()}").alias("bound_calls")) for m in models])).alias("_r")).select("_r.*")
    sums = tall.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("warning_calls", "warning_count", "bound_calls")])
    six = six_numbers(tall, ["model"], {"unique_payloads": F.col("unique_payloads")}).drop("quantity")
    n = calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"))
    states = status_counts(calls, ["model"], "status")
    return attach(attach(attach(n, sums, ["model"]), states, ["model"]), six, ["model"])


def seed_completeness(df: DataFrame, by: Sequence[str], seeds: int, seed: str = "seed") -> DataFrame:
    """Groups whose seeds are not exactly ``0 .. seeds-1`` once each."""
    s = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(seed).alias("n_seeds"),
                            F.min(seed).alias("lo"), F.max(seed).alias("hi"))
    ok = ((F.col("n_rows") == seeds) & (F.col("n_seeds") == seeds) & (F.col("lo") == 0) & (F.col("hi") == seeds - 1))
    return s.where(~ok)


def stability_label(stable: DataFrame) -> DataFrame:
    """Name the seed behaviour of each series from its counts."""
    n, k = F.col("n_seeds"), F.col("n_selected")
    return stable.withColumn("stability", F.when(k == n, "STABLE_REPRODUCTION")
                             .when(k == 0, "STABLE_NOT_SELECTED").otherwise("SEED_DEPENDENT"))


def seed_estimate(df: DataFrame, by: Sequence[str], value: str, published: str) -> DataFrame:
    """Median, lowest and highest estimate over seeds and its distance from a published value."""
    flat = df.where(is_finite(F.col(value)))
    ends = [F.count(F.lit(1)).alias("n"), F.min(value).alias("lowest"), F.max(value).alias("highest"),
            F.max(published).alias("published")]
    out = grouped(flat, by, ends, {"_m": F.col(value)}, (0.5,))
    out = out.withColumn("median", F.try_element_at("_m", F.lit(1))).drop("_m")
    return out.withColumns({"difference": F.col("median") - F.col("published"),
                            "difference_percent": safe_ratio(F.abs(F.col("median") - F.col("published")) * 100.0,
                                                             F.col("published"))})


def _outcome_counts() -> list[Column]:
    t = F.col("transition")
    return [
        F.count(F.lit(1)).alias("planned"),
        F.count_if(F.col("status") == L.ELIGIBLE).alias("eligible"),
        F.count_if(F.col("status") == L.INADMISSIBLE).alias("inadmissible"),
        F.count_if((F.col("status") == L.ELIGIBLE) & F.col("selected").isNull()).alias("incomplete"),
        F.count_if(F.col("transition_eligible")).alias("transition_eligible"),
        *[F.count_if(t == name).alias(name.lower()) for name in L.TRANSITIONS],
        F.count_if(F.coalesce(F.col("concordant"), F.lit(False))).alias("concordant"),
    ]


def event_summary(rows: DataFrame, reasons: Sequence[str], windows: Sequence[str], profiles: Sequence[str]) -> DataFrame:
    """Per event: counts, concordance, reasons, and where the classification changed."""
    changed = F.col("transition").isin("SELECTION_LOST", "SELECTION_GAINED")
    where = lambda c, order: L.joined(F.collect_set(F.when(changed, F.col(c))), order)
    out = rows.groupBy("event_id").agg(
        F.max("gate_state").alias("gate_state"), *_outcome_counts(),
        *[F.count_if(F.col("reason") == r).alias(f"inadmissible_{r.lower()}") for r in reasons],
        where("profile_id", profiles).alias("changed_profiles"),
        where("window_id", windows).alias("changed_windows"),
        F.min("joint_margin").alias("joint_margin_min"), F.max("joint_margin").alias("joint_margin_max"),
    )
    return out.withColumn("concordance", safe_ratio(F.col("concordant"), F.col("transition_eligible")))


def group_summary(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Outcome counts per cell, window or profile, with distinct concordant events and a reason map."""
    out = rows.groupBy(*by).agg(*_outcome_counts())
    gate = (rows.where(F.col("gate_state") == L.CONCORDANT).groupBy(*by)
            .agg(F.countDistinct("event_id").alias("concordant_events")))
    why = status_counts(rows, by, "reason", "reason_counts")
    out = attach(attach(out, gate, by), why, by)
    return out.withColumns({
        "concordant_events": F.coalesce("concordant_events", F.lit(0).cast("bigint")),
        "reason_counts": F.coalesce("reason_counts", F.lit("{}")),
        "concordance": safe_ratio(F.col("concordant"), F.col("transition_eligible")),
    })


def inadmissibility_table(rows: DataFrame, scopes: Sequence[str], reasons: Sequence[str]) -> DataFrame:
    """Counts per scope and reason, with a zero row for every reason that never occurs.

    One pass of GROUPING SETS gives the counts; the reasons are unpivoted from fixed counters,
    so absent reasons are zeros rather than missing rows.
    """
    bad = F.col("status") == L.INADMISSIBLE
    counters = [F.count_if(bad).alias("_r_ALL")]
    counters += [F.count_if(bad & (F.col("reason") == r)).alias(f"_r_{r}") for r in reasons]
    which = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in scopes], F.lit("global"))
    agg = rows.groupingSets([[], *[[F.col(c)] for c in scopes]], *[F.col(c) for c in scopes]).agg(
        which.alias("scope"), F.count(F.lit(1)).alias("planned"), *counters)
    value = F.coalesce(*[F.col(c).cast("string") for c in scopes], F.lit("ALL"))
    tall = agg.select(
        "scope", value.alias("scope_value"), "planned",
        F.explode(F.array(*[F.struct(F.lit(r).alias("reason"), F.col(f"_r_{r}").alias("n"))
                            for r in ("ALL", *reasons)])).alias("_s"))
    return tall.select("scope", "scope_value", "planned", F.col("_s.reason").alias("reason"),
                       F.col("_s.n").alias("inadmissible"),
                       safe_ratio(F.col("_s.n"), F.col("planned")).alias("fraction"))


def concordance_extremes(cells: DataFrame, role: str, cell: str) -> DataFrame:
    """Cell of lowest and of highest concordance per role, ties to the smaller cell name."""
    ok = cells.where(F.col("concordance").isNotNull())
    low = F.min(F.struct("concordance", cell))
    high = F.min(F.struct((-F.col("concordance")).alias("c"), F.col(cell)))
    return ok.groupBy(role).agg(low.alias("_l"), high.alias("_h")).select(
        role, F.col(f"_l.{cell}").alias("lowest_cell"), F.col("_l.concordance").alias("lowest"),
        F.col(f"_h.{cell}").alias("highest_cell"), (-F.col("_h.c")).alias("highest"))


def group_size_histogram(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"))
    return sizes.groupBy("group_rows").agg(F.count(F.lit(1)).alias("groups"))


def zero_filled_counts(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Count per domain value with explicit zeros; values outside the domain are left to a check."""
    spark = df.sparkSession
    names = spark.createDataFrame([(v,) for v in domain], f"{column} string")
    got = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return names.join(got, column, "left").select(column, F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def corpus_counts(hits: DataFrame, provider: str = "source", query: str = "query", record: str = "record_id") -> DataFrame:
    """Hits by provider, query and both, with distinct records per grouping.

    Distinct (provider, query, record) triples are counted first; the GROUPING SETS pass then
    works on that reduced table.
    """
    p, q = F.col(provider), F.col(query)
    flat = hits.groupBy(provider, query, record).agg(F.count(F.lit(1)).alias("_n"))
    return flat.groupingSets([[p], [q], [p, q]], p, q).agg(
        F.sum("_n").alias("hits"), F.countDistinct(record).alias("records"))


def crossing_totals(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Totals of the four threshold crossings and two selection crossings."""
    flags = ("cross_m0_up", "cross_m0_down", "cross_m2_up", "cross_m2_down", "selection_up", "selection_down")
    return steps.groupBy(*by).agg(F.count(F.lit(1)).alias("steps"), *[F.count_if(F.col(f)).alias(f) for f in flags])


def support_strata(steps: DataFrame, by: Sequence[str], value: str = "support_contrast",
                   group_rows: int | None = None) -> DataFrame:
    """Quartiles and sign counts of the support contrast per stratum."""
    ok = steps.where(is_finite(F.col(value)))
    signs = {s: f"n_{s.lower()}" for s in ("POSITIVE", "NEGATIVE", "ZERO")}
    counts = [F.count_if(L.sign_label(F.col(value)) == s).alias(n) for s, n in signs.items()]
    out = grouped(ok, by, [F.count(F.lit(1)).alias("n"), *counts], {"_q": F.col(value)}, SIX, group_rows)
    return out.select(*by, "n", *signs.values(),
                      *[F.try_element_at("_q", F.lit(i + 1)).alias(n) for i, n in enumerate(("q1", "median", "q3"))])


def error_table(df: DataFrame, by: Sequence[str], group_rows: int | None = None) -> DataFrame:
    """Median absolute error for selected rows and for all rows, with both counts."""
    ok = df.where(is_finite(F.col("absolute_error")))
    out = grouped(ok, by, [F.count(F.lit(1)).alias("n_formal"), F.count_if(F.col("selected")).alias("n_selected")],
                  {"_f": F.col("absolute_error"), "_s": F.when(F.col("selected"), F.col("absolute_error"))}, (0.5,), group_rows)
    return out.select(*by, "n_formal", "n_selected", F.try_element_at("_f", F.lit(1)).alias("formal_median"),
                      F.try_element_at("_s", F.lit(1)).alias("selected_median"))
