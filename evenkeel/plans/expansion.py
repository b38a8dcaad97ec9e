"""Plan expansion: perturbation cells, decision plans, surrogate ids and resume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.ordered import number_rows

# Window perturbations (name, start shift, end shift) and processing profiles
# (name, flux column, quality policy, detrending).
WINDOWS = (
    ("W00", 0, 0), ("WSm2", -2, 0), ("WSm1", -1, 0), ("WSp1", 1, 0), ("WSp2", 2, 0),
    ("WEm2", 0, -2), ("WEm1", 0, -1), ("WEp1", 0, 1), ("WEp2", 0, 2),
    ("WX1", -1, 1), ("WC1", 1, -1), ("WX2", -2, 2), ("WC2", 2, -2),
)
PROFILES = (
    ("P00", "primary", "finite_all", "none"),
    ("P01", "alternate", "finite_all", "none"),
    ("P02", "primary", "q0_native", "none"),
    ("P03", "alternate", "q0_native", "none"),
    ("P04", "primary", "finite_all", "linear_residual_plus_one"),
    ("P05", "alternate", "finite_all", "linear_residual_plus_one"),
)
PAD = max(max(abs(ds), abs(de)) for _, ds, de in WINDOWS)


def cells(windows: Sequence[tuple] = WINDOWS, profiles: Sequence[tuple] = PROFILES) -> Column:
    """The full grid of windows and profiles as one literal array column."""
    rows = ", ".join(
        f"named_struct('window_id', '{w}', 'ds', {ds}L, 'de', {de}L, 'profile_id', '{p}', 'flux', '{flux}', "
        f"'policy', '{policy}', 'detrending', '{det}')"
        for w, ds, de in windows for p, flux, policy, det in profiles)
    return F.expr(f"array({rows})")


def expand_cells(events: DataFrame, grid: Column | None = None) -> DataFrame:
    """Events x cells; the grid is a constant of the plan, so no join is needed."""
    c = events.withColumn("_c", F.explode(cells() if grid is None else grid))
    return c.select(*events.columns, "_c.*")


def plan_jobs(decisions: DataFrame, models: Sequence[str] = ("M0", "M1", "M2"), order: str = "decision_order") -> DataFrame:
    """Decision x model plan with a job order that follows the decision order."""
    m = F.posexplode(F.array(*[F.lit(x) for x in models])).alias("_i", "model")
    out = decisions.select("*", m)
    return out.withColumn("job_order", (F.col(order) - 1) * len(models) + F.col("_i") + 1).drop("_i")


def numbered(number: Column, prefix: str, width: int) -> Column:
    """``<prefix><number>``, padded to ``width`` digits."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.lit(width), F.length(text)), "0"))


def surrogate_ids(df: DataFrame, order: Sequence[Column], prefix: str, width: int, name: str) -> DataFrame:
    """Ids ``<prefix><number>`` in a declared total order."""
    out = number_rows(df, [], order, "_n")
    return out.withColumn(name, numbered(F.col("_n"), prefix, width)).drop("_n")


def pending(plan: DataFrame, results: DataFrame, key: str = "job_id") -> DataFrame:
    """Jobs of the plan that have no result row yet."""
    return plan.join(results.select(key).distinct(), key, "left_anti")


def next_jobs(plan: DataFrame, results: DataFrame, n: int, key: str = "job_id", order: str = "job_order") -> DataFrame:
    """The next ``n`` pending jobs in plan order."""
    return pending(plan, results, key).orderBy(order, key).limit(n)


def blinded(plan: DataFrame, truth: Sequence[str]) -> DataFrame:
    """The plan without any column that carries the truth."""
    return plan.drop(*truth)
