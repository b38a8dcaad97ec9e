"""Threshold axis and exact two-threshold search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.numeric import THRESHOLD, is_finite
from evenkeel.operators.ordered import neighbours, number_rows, running_sum
from evenkeel.session import discard, group_rows_limit, materialize

#: Parts of a cell along each axis in one round: the square while few cells are left, for fewer rounds.
CUT, FEW = 4, 256


def threshold_axis(df: DataFrame, value: str, extra: float = THRESHOLD) -> DataFrame:
    """Ascending distinct finite values, the midpoints between neighbours, and ``extra``."""
    v = df.where(is_finite(F.col(value))).select(F.col(value).alias("threshold")).distinct()
    seen = neighbours(v, [], [F.col("threshold")], next={"_next": F.col("threshold")})
    mid = F.when(F.col("_next").isNotNull(), F.col("threshold") + (F.col("_next") - F.col("threshold")) / 2.0)
    both = seen.select(F.explode(F.array_compact(F.array(F.col("threshold"), mid, F.lit(float(extra))))).alias("threshold"))
    return both.distinct()


def _levels(df: DataFrame, value: str, rank: str) -> DataFrame:
    return materialize(number_rows(df.select(value).distinct(), [], [F.col(value)], rank))


def _counts_beyond(points: DataFrame, queries: DataFrame, strip: str, along: str, rows: int) -> DataFrame:
    """For each distinct ``(strip, at)`` of ``queries`` the positives and negatives of that strip with ``along > at``.

    Points and queries go into one order along the strip; a running sum from the far end answers every query. ``rows``
    bounds the rows of all strips together.
    """
    asked = queries.select(strip, F.col("at").cast("bigint").alias("at")).distinct()
    none = F.lit(0).cast("bigint")
    wanted = points.join(asked.select(strip).distinct(), strip, "left_semi")
    merged = (asked.select(strip, (-F.col("at")).alias("_o"), F.lit(0).alias("_kind"), none.alias("pos"), none.alias("neg"))
              .unionByName(wanted.groupBy(strip, (-F.col(along)).alias("_o")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).withColumn("_kind", F.lit(1))))
    fits = rows if rows <= group_rows_limit(points.sparkSession) else None
    told = running_sum(merged, [strip], [F.col("_o"), F.col("_kind")], {"p": F.col("pos"), "q": F.col("neg")}, fits)
    return told.where("_kind = 0").select(strip, (-F.col("_o")).alias("at"), "p", "q")


def _split(cells: DataFrame, points: DataFrame, width: int, cut: int, rows: int) -> DataFrame:
    """Cut every cell in ``cut`` along both axes, with the counts at the low corner of each part and at its far corner.

    ``cells(x, y, p, q)``: low corner, positives and negatives that pass there. Going from a corner to the next one along an axis
    drops the points of the strip between them, so each corner follows from the low one and counts in strips: first along x
    at the low edge, then along y at each of these places.
    """
    part = width // cut
    steps = F.sequence(F.lit(0), F.lit(cut - 1))
    columns = points.select((F.floor((F.col("r1") - 1) / part)).cast("bigint").alias("strip"), "r2", "pos", "neg")
    lines = points.select((F.floor((F.col("r2") - 1) / part)).cast("bigint").alias("strip"), "r1", "pos", "neg")
    first = cells.withColumn("i", F.explode(steps)).withColumn("strip", F.expr(f"x div {part}L") + F.col("i"))
    found = _counts_beyond(columns, first.select("strip", F.col("y").alias("at")), "strip", "r2", rows)
    first = first.join(found.withColumnsRenamed({"at": "y", "p": "dp", "q": "dq"}), ["strip", "y"])
    lost = lambda c, upto: F.aggregate(F.slice(c, F.lit(1), upto), F.lit(0).cast("bigint"), lambda s, v: s + v)
    ordered = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    edge = first.groupBy("x", "y", "p", "q").agg(ordered("i", "dp", "dq").alias("d"))
    edge = edge.withColumns({"dp": F.transform("d", lambda v: v["dp"]), "dq": F.transform("d", lambda v: v["dq"])})
    edge = edge.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(cut))))
    edge = edge.select("x", "y", "i", (F.col("p") - lost(F.col("dp"), F.col("i"))).alias("p"), (F.col("q") - lost(F.col("dq"), F.col("i"))).alias("q"))
    second = edge.withColumn("j", F.explode(steps)).withColumns({"strip": F.expr(f"y div {part}L") + F.col("j"), "at": F.col("x") + F.col("i") * part})
    found = _counts_beyond(lines, second, "strip", "r1", rows)
    second = second.join(found.withColumnsRenamed({"p": "dp", "q": "dq"}), ["strip", "at"])
    lattice = second.groupBy("x", "y", "i", "p", "q").agg(ordered("j", "dp", "dq").alias("d"))
    lattice = lattice.withColumns({"dp": F.transform("d", lambda v: v["dp"]), "dq": F.transform("d", lambda v: v["dq"])})
    upto = lambda c, total: F.transform(F.sequence(F.lit(0), F.lit(cut)), lambda j: F.col(total) - lost(F.col(c), j))
    lattice = lattice.select("x", "y", "i", upto("dp", "p").alias("ps"), upto("dq", "q").alias("qs"))
    # negatives at the far corner pass every state of the part
    grid = lattice.groupBy("x", "y").agg(ordered("i", "ps", "qs").alias("g"))
    parts = F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.struct(
        i.alias("i"), j.alias("j"), F.col("g")[i]["ps"][j].alias("p"), F.col("g")[i]["qs"][j].alias("q"), F.col("g")[i + 1]["qs"][j + 1].alias("sure")))))
    out = grid.select("x", "y", F.explode(parts).alias("c"))
    return out.select((F.col("x") + F.col("c.i") * part).alias("x"), (F.col("y") + F.col("c.j") * part).alias("y"), "c.p", "c.q", "c.sure")


def threshold_search(df: DataFrame, d01: str = "d01", d21: str = "d21", truth: str = "truth", extra: float = THRESHOLD) -> DataFrame:
    """Best pair of strict thresholds by a six-level objective, over the whole threshold plane.

    Objective: balanced accuracy, min(sensitivity, specificity), low false-positive rate, small
    L1 distance to (10, 10), large t01, large t21. Only the ranks of the distinct values matter
    for the counts, so a threshold is a *state* ``s``: points of rank above ``s`` pass.

    Exact branch and bound over square cells of states, which are rows of a table. Every round cuts each cell into smaller ones. The
    low corner of a part gives attained values; its best possible values take every positive that passes there and only
    the negatives that pass its far corner. Parts that cannot reach the best attained (balanced accuracy, minimum, false
    positives) are dropped; ties survive. After at most log4 of the number of values rounds all cells are single states. A round sorts points
    and corners along both axes and needs no more of the driver than the best values. Both classes are needed.
    """
    spark = df.sparkSession
    clean = df.where(is_finite(F.col(d01)) & is_finite(F.col(d21)) & F.col(truth).isNotNull())
    xs, ys = _levels(clean, d01, "r1"), _levels(clean, d21, "r2")
    pts = clean.join(xs, d01).join(ys, d21).groupBy("r1", "r2").agg(
        F.count_if(F.col(truth)).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
    pts = materialize(pts)
    n_pos, n_neg, k1, k2, rows = pts.agg(F.sum("pos"), F.sum("neg"), F.max("r1"), F.max("r2"), F.count(F.lit(1))).first()
    if not n_pos or not n_neg:
        raise ValueError("both classes need finite values")
    # The state that drops nothing exists only where an axis value lies below the smallest one.
    low1, low2 = (0 if extra < level.agg(F.min(value)).first()[0] else 1 for level, value in ((xs, d01), (ys, d21)))
    exact = (lambda c: c.cast("decimal(38,0)")) if n_pos * n_neg > 2**61 else (lambda c: c.cast("bigint"))
    pos, neg = exact(F.lit(n_pos)), exact(F.lit(n_neg))
    merit = lambda p, q: F.struct((exact(p) * neg - exact(q) * pos).alias("a"), F.least(exact(p) * neg, (neg - exact(q)) * pos).alias("b"), (-q).alias("c"))
    possible = lambda p, sure: F.struct((exact(p) * neg - exact(sure) * pos).alias("a"), F.least(exact(p) * neg, (neg - exact(sure)) * pos).alias("b"), (-sure).alias("c"))
    width = CUT
    while width < max(k1, k2) + 1:
        width *= CUT
    cells = spark.createDataFrame([(0, 0, n_pos, n_neg)], "x bigint, y bigint, p bigint, q bigint")
    best, held = None, 1
    while width > 1:
        cut = CUT * CUT if held <= FEW and width >= CUT * CUT else CUT
        parts = _split(cells, pts, width, cut, rows + 2 * cut * cut * held)
        old, width = cells, width // cut
        parts = parts.where((F.col("x") <= k1) & (F.col("y") <= k2) & (F.col("x") + width > low1) & (F.col("y") + width > low2))
        parts = materialize(parts)
        real = parts.where((F.col("x") >= low1) & (F.col("y") >= low2))
        top = real.agg(F.max(merit(F.col("p"), F.col("q")))).first()[0]
        if top is not None:
            best = max(best, tuple(top)) if best else tuple(top)
        reach = merit(F.col("p"), F.col("q")) if width == 1 else possible(F.col("p"), F.col("sure"))
        goal = None if best is None else F.struct(*[exact(F.lit(int(v))).alias(n) for v, n in zip(best[:2], "ab")], F.lit(int(best[2])).cast("bigint").alias("c"))
        kept = parts if goal is None else parts.where(reach >= goal)
        cells = materialize(kept.select("x", "y", "p", "q"))
        held = cells.count()
        discard(parts)
        if hasattr(old, "materialized_at"):
            discard(old)
    cells = cells.where((F.col("x") >= low1) & (F.col("y") >= low2))
    t1, t2 = _closest(cells.select(F.col("x").alias("s")), xs, d01, "r1", extra), _closest(cells.select(F.col("y").alias("s")), ys, d21, "r2", extra)
    ties = cells.join(t1.withColumnsRenamed({"s": "x", "t": "t01"}), "x").join(t2.withColumnsRenamed({"s": "y", "t": "t21"}), "y")
    away = F.abs(F.col("t01") - THRESHOLD) + F.abs(F.col("t21") - THRESHOLD)
    won = ties.agg(F.max(F.struct((-away).alias("near"), "t01", "t21", "p", "q")).alias("w")).select("w.*")
    sens, spec = F.col("p") / F.lit(n_pos), (F.lit(n_neg) - F.col("q")) / F.lit(n_neg)
    return won.select("t01", "t21", F.col("p").alias("TP"), (F.lit(n_pos) - F.col("p")).alias("FN"), (F.lit(n_neg) - F.col("q")).alias("TN"), F.col("q").alias("FP"),
                      sens.alias("sensitivity"), spec.alias("specificity"), ((sens + spec) / 2).alias("balanced_accuracy"), (-F.col("near")).alias("l1_distance"),
                      F.lit(k1).cast("bigint").alias("values01"), F.lit(k2).cast("bigint").alias("values21"))


def _closest(states: DataFrame, levels: DataFrame, value: str, rank: str, extra: float) -> DataFrame:
    """``(s, t)``: the axis value inside each state that lies closest to 10, the larger one on a tie.

    A state begins at the value of its rank and ends before the next one; state 0 has no beginning.
    """
    own = states.distinct()
    low = levels.select(F.col(rank).alias("s"), F.col(value).alias("lo"))
    high = levels.select((F.col(rank) - 1).alias("s"), F.col(value).alias("hi"))
    both = own.join(low, "s", "left").join(high, "s", "left")
    more = F.lit(float(extra))
    fits = (F.col("lo").isNull() | (more >= F.col("lo"))) & (F.col("hi").isNull() | (more < F.col("hi")))
    inside = F.array_compact(F.array(F.col("lo"), F.col("lo") + (F.col("hi") - F.col("lo")) / 2.0, F.when(fits, more)))
    near = F.array_max(F.transform(inside, lambda v: F.struct((-F.abs(v - THRESHOLD)).alias("d"), v.alias("v"))))
    return both.select("s", near["v"].alias("t"))
