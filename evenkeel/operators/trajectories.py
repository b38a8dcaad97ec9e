"""Selection along a declared sequence of lengths: trajectories and steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions import labels as L
from evenkeel.operators.ordered import neighbours
from evenkeel.operators.quality import domain


def trajectory(rows: DataFrame, by: Sequence[str], lengths: Sequence[int], n: str = "n_samples") -> DataFrame:
    """Selection sequence of each group over the declared lengths.

    ``rows(by, n, selected, d01, d21, joint_margin, limiting_model)``, one row per group and
    length. Rows of undeclared lengths are not part of the design, so a group holds at most
    ``len(lengths)`` rows and its sequence is a short array.
    """
    item = F.struct(F.col(n).alias("n"), *[F.col(c).alias(c) for c in
                                           ("selected", "d01", "d21", "joint_margin", "limiting_model")])
    g = rows.where(F.col(n).isin(*lengths)).groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("_s"))
    s = F.col("_s")
    later = F.slice(s, 2, len(lengths))
    pairs = F.zip_with(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), later,
                       lambda a, b: b["selected"].cast("int") - a["selected"].cast("int"))
    chosen = F.filter(s, lambda x: x["selected"])
    last_off = F.array_max(F.transform(F.filter(s, lambda x: ~x["selected"]), lambda x: x["n"]))
    stable = F.filter(chosen, lambda x: last_off.isNull() | (x["n"] > last_off))
    text = lambda f: F.array_join(F.transform(s, f), "")
    listed = lambda c: F.array_join(F.transform(s, lambda x: F.coalesce(F.format_string("%.6f", x[c]), F.lit("null"))), ",")
    return g.select(
        *by,
        F.array_join(F.transform(s, lambda x: x["n"].cast("string")), "|").alias("n_sequence"),
        text(lambda x: x["selected"].cast("int").cast("string")).alias("selection_sequence"),
        (F.size(chosen) > 0).alias("ever_selected"), F.size(chosen).cast("bigint").alias("selected_lengths"),
        F.size(F.filter(pairs, lambda d: d == 1)).cast("bigint").alias("ups"),
        F.size(F.filter(pairs, lambda d: d == -1)).cast("bigint").alias("downs"),
        F.try_element_at(chosen, F.lit(1))["n"].alias("first_selected_n"),
        F.try_element_at(stable, F.lit(1))["n"].alias("stable_from_n"),
        F.concat(F.lit("["), listed("d01"), F.lit("]")).alias("d01_sequence"),
        F.concat(F.lit("["), listed("joint_margin"), F.lit("]")).alias("joint_margin_sequence"),
        F.array_join(F.transform(s, lambda x: x["limiting_model"]), "|").alias("limiting_sequence"),
    )


def undeclared_lengths(rows: DataFrame, lengths: Sequence[int], n: str = "n_samples") -> DataFrame:
    """One violation for each length that is in the rows but not in the design, with its row count: no row vanishes in silence."""
    return domain(rows, n, lengths, "undeclared_length")


def steps(rows: DataFrame, by: Sequence[str], lengths: Sequence[int], n: str = "n_samples",
          threshold: float = 10.0) -> DataFrame:
    """Changes and crossings between consecutive lengths of each group.

    ``truth`` (boolean) decides whether a support contrast is formed.
    """
    kept = rows.where(F.col(n).isin(*lengths))
    nxt = {f"to_{c}": F.col(c) for c in (n, "d01", "d21", "joint_margin", "selected")}
    out = neighbours(kept, by, [F.col(n)], next=nxt, group_rows=len(lengths)).where(F.col(f"to_{n}").isNotNull())
    change = lambda c: F.col(f"to_{c}") - F.col(c)
    support = F.when(F.col("truth"), change("d01") - change("d21"))
    up = lambda c: (F.col(c) <= threshold) & (F.col(f"to_{c}") > threshold)
    down = lambda c: (F.col(c) > threshold) & (F.col(f"to_{c}") <= threshold)
    return out.select(
        *by, "truth", F.concat(F.col(n).cast("string"), F.lit("_to_"), F.col(f"to_{n}").cast("string")).alias("step"),
        change("d01").alias("change_01"), change("d21").alias("change_21"), change("joint_margin").alias("change_joint"),
        support.alias("support_contrast"), L.sign_label(support).alias("support_sign"),
        up("d01").alias("cross_m0_up"), down("d01").alias("cross_m0_down"),
        up("d21").alias("cross_m2_up"), down("d21").alias("cross_m2_down"),
        (~F.col("selected") & F.col("to_selected")).alias("selection_up"),
        (F.col("selected") & ~F.col("to_selected")).alias("selection_down"))
