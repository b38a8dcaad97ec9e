"""Ordered-group operators that survive one group holding most of the rows.

A plain ``Window.partitionBy(key).orderBy(...)`` sorts each group inside one task. That
is the best plan while groups are small, so it is used when the largest group is known
(``group_rows``) or measured to be below ``evenkeel.group.rows``. Otherwise the rows are
range-partitioned on ``(key, order)`` so that a large group is spread over many
consecutive *runs*; each run is solved by itself and the carries between runs are added
afterwards. At most one group crosses each run boundary, so the carry table has at most
two rows per run whatever the data size: that is the proof for broadcasting it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.session import group_rows_limit, materialize, shuffle_parts

RUN = "_run"


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Row count of the largest group (counted map-side first)."""
    if not by:
        return df.count()
    top = df.groupBy(*by).count().agg(F.max("count")).first()[0]
    return top or 0


def fits_one_task(df: DataFrame, by: Sequence[str], group_rows: int | None) -> bool:
    bound = group_rows if group_rows is not None else largest_group(df, by)
    return bound <= group_rows_limit(df.sparkSession)


def _window(by: Sequence[str], order: Sequence[Column], *extra: str):
    keys = [F.col(c) for c in (*by, *extra)] or [F.lit(0)]
    return Window.partitionBy(*keys).orderBy(*order)


def _split(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    parts = shuffle_parts(df.sparkSession)
    ranged = df.repartitionByRange(parts, *[F.col(c) for c in by], *order)
    return materialize(ranged.withColumn(RUN, F.spark_partition_id()))


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on ``keys`` between two frames."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def _crossing(runs: DataFrame, by: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """One row per (group, run), only for groups that lie in more than one run."""
    per_run = runs.groupBy(*by, RUN).agg(*aggs)
    spans = runs.groupBy(*by).agg(F.min(RUN).alias("_lo"), F.max(RUN).alias("_hi"))
    spans = spans.where("_lo < _hi")
    picked = per_run.alias("p").join(F.broadcast(spans).alias("s"),
                                     same_keys(per_run, spans, by) if by else F.lit(True), "left_semi")
    return picked


def _attach(runs: DataFrame, carry: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    keys = [*by, RUN]
    slim = carry.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *fields)
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    joined = runs.join(F.broadcast(slim), cond, "left")
    return joined.drop(*[f"_k_{k}" for k in keys])


def running_sum(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    group_rows: int | None = None,
) -> DataFrame:
    """Add running totals (current row included) of ``sums`` in ``order`` within ``by``."""
    frame = lambda *x: _window(by, order, *x).rowsBetween(Window.unboundedPreceding, 0)
    if fits_one_task(df, by, group_rows):
        return df.withColumns({a: F.sum(c).over(frame()) for a, c in sums.items()})
    runs = _split(df.withColumns({f"_v_{a}": c for a, c in sums.items()}), by, order)
    totals = _crossing(runs, by, [F.sum(f"_v_{a}").alias(f"_t_{a}") for a in sums])
    before = _window(by, [F.col(RUN)]).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"_o_{a}": F.sum(f"_t_{a}").over(before) for a in sums})
    out = _attach(runs, totals, by, [f"_o_{a}" for a in sums])
    out = out.withColumns(
        {a: F.coalesce(F.sum(f"_v_{a}").over(frame(RUN)) + F.col(f"_o_{a}"), F.sum(f"_v_{a}").over(frame(RUN)), F.col(f"_o_{a}"))
         for a in sums}
    )
    return out.select(*df.columns, *sums)


def number_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    name: str,
    group_rows: int | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in ``order`` within ``by``; ``order`` must be total."""
    if fits_one_task(df, by, group_rows):
        return df.withColumn(name, F.row_number().over(_window(by, order)).cast("bigint"))
    runs = _split(df, by, order)
    sizes = _crossing(runs, by, [F.count(F.lit(1)).alias("_t_n")])
    before = _window(by, [F.col(RUN)]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_o_n", F.sum("_t_n").over(before))
    out = _attach(runs, sizes, by, ["_o_n"])
    place = F.row_number().over(_window(by, order, RUN)) + F.coalesce(F.col("_o_n"), F.lit(0))
    return out.withColumn(name, place.cast("bigint")).select(*df.columns, name)


def neighbours(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    prev: Mapping[str, Column] | None = None,
    next: Mapping[str, Column] | None = None,  # noqa: A002
    group_rows: int | None = None,
    among: Column | None = None,
) -> DataFrame:
    """Add values of the row before (``prev``) and the row after (``next``) in ``order``.

    ``order`` holds plain ascending columns and is total.
    With ``among`` every row gets the last non-null value of the earlier rows that satisfy it; ``next`` is not allowed then.
    """
    prev, next = prev or {}, next or {}
    if among is not None:
        if next:
            raise ValueError("among works on earlier neighbours only")
        lagged = neighbours(df, by, order, prev={f"_among_{a}": F.when(among, c) for a, c in prev.items()}, group_rows=group_rows)
        out = carry(lagged, by, order, back={a: F.col(f"_among_{a}") for a in prev}, group_rows=group_rows)
        return out.select(*df.columns, *prev)
    if fits_one_task(df, by, group_rows):
        w = _window(by, order)
        return df.withColumns(
            {a: F.lag(c).over(w) for a, c in prev.items()} | {a: F.lead(c).over(w) for a, c in next.items()}
        )
    both = {f"_p_{a}": c for a, c in prev.items()} | {f"_n_{a}": c for a, c in next.items()}
    runs = _split(df.withColumns(both), by, order)
    key = F.struct(*order)
    one = F.lit(1).alias("_1")
    ends = _crossing(runs, by, [
        F.max_by(F.struct(*[F.col(f"_p_{a}") for a in prev], one), key).alias("_tail"),
        F.min_by(F.struct(*[F.col(f"_n_{a}") for a in next], one), key).alias("_head")])
    w = _window(by, [F.col(RUN)])
    ends = ends.withColumns({"_tail_b": F.lag("_tail").over(w), "_head_a": F.lead("_head").over(w)})
    out = _attach(runs, ends, by, ["_tail_b", "_head_a"])
    place = _window(by, order, RUN)
    first, last = F.lag(F.lit(1)).over(place).isNull(), F.lead(F.lit(1)).over(place).isNull()
    out = out.withColumns(
        {a: F.when(first, F.col("_tail_b")[f"_p_{a}"]).otherwise(F.lag(f"_p_{a}").over(place)) for a in prev}
        | {a: F.when(last, F.col("_head_a")[f"_n_{a}"]).otherwise(F.lead(f"_n_{a}").over(place)) for a in next}
    )
    return out.select(*df.columns, *prev, *next)


def carry(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    back: Mapping[str, Column] | None = None,
    ahead: Mapping[str, Column] | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    """Add the last non-null value at or before each row (``back``) and the first at or after (``ahead``).

    ``order`` holds plain ascending columns. Looking ahead is looking back in falling order: a frame
    that ends at the partition's end would be recomputed for every row.
    """
    back, ahead = back or {}, ahead or {}
    falling = [c.desc() for c in order]
    lo = lambda *x: _window(by, order, *x).rowsBetween(Window.unboundedPreceding, 0)
    hi = lambda *x: _window(by, falling, *x).rowsBetween(Window.unboundedPreceding, 0)
    if fits_one_task(df, by, group_rows):
        return df.withColumns(
            {a: F.last(c, ignorenulls=True).over(lo()) for a, c in back.items()}
            | {a: F.last(c, ignorenulls=True).over(hi()) for a, c in ahead.items()}
        )
    vals = {f"_b_{a}": c for a, c in back.items()} | {f"_a_{a}": c for a, c in ahead.items()}
    runs = _split(df.withColumns(vals), by, order)
    key = F.struct(*order)
    set_at = lambda c: F.when(F.col(c).isNotNull(), key)
    ends = _crossing(
        runs, by,
        [F.max_by(f"_b_{a}", set_at(f"_b_{a}")).alias(f"_eb_{a}") for a in back]
        + [F.min_by(f"_a_{a}", set_at(f"_a_{a}")).alias(f"_ea_{a}") for a in ahead],
    )
    before = _window(by, [F.col(RUN)]).rowsBetween(Window.unboundedPreceding, -1)
    after = _window(by, [F.col(RUN)]).rowsBetween(1, Window.unboundedFollowing)
    ends = ends.withColumns(
        {f"_cb_{a}": F.last(f"_eb_{a}", ignorenulls=True).over(before) for a in back}
        | {f"_ca_{a}": F.first(f"_ea_{a}", ignorenulls=True).over(after) for a in ahead}
    )
    out = _attach(runs, ends, by, [f"_cb_{a}" for a in back] + [f"_ca_{a}" for a in ahead])
    out = out.withColumns(
        {a: F.coalesce(F.last(f"_b_{a}", ignorenulls=True).over(lo(RUN)), F.col(f"_cb_{a}")) for a in back}
        | {a: F.coalesce(F.last(f"_a_{a}", ignorenulls=True).over(hi(RUN)), F.col(f"_ca_{a}")) for a in ahead}
    )
    return out.select(*df.columns, *back, *ahead)


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    values: Mapping[str, Column],
    probs: Sequence[float],
    group_rows: int | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles of each value column, one array per column.

    NULL and non-finite values are ignored. Small groups use the ``percentile`` aggregate.
    Large groups are first reduced to (value, count) pairs map-side, then ranked by a
    running count, so that neither many rows nor many copies of one value meet in a task.
    """
    from evenkeel.functions.numeric import finite_or_null

    clean = df.select(*by, *[finite_or_null(c.cast("double")).alias(a) for a, c in values.items()])
    if fits_one_task(clean, by, group_rows):
        levels = F.array(*[F.lit(float(p)) for p in probs])
        return clean.groupBy(*by).agg(*[F.percentile(a, levels).alias(a) for a in values])

    tall = clean.unpivot(list(by), list(values), "_name", "_x") if by else clean.select(
        F.explode(F.array(*[F.struct(F.lit(a).alias("_name"), F.col(a).alias("_x")) for a in values])).alias("_s")
    ).select("_s.*")
    keys = [*by, "_name"]
    counts = tall.where("_x is not null").groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))
    upto = running_sum(counts, keys, [F.col("_x")], {"_cum": F.col("_c")})
    upto = materialize(upto)
    sizes = upto.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    spot = sizes.select(
        *keys, "_n",
        F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_i", "_p"),
    ).withColumn("_at", (F.col("_n") - 1) * F.col("_p"))
    spot = spot.withColumns({"_f": F.floor("_at"), "_g": F.ceil("_at")})
    # Each wanted rank lies in exactly one (value, count) step: find it as the first step whose
    # running count exceeds the rank, by merging ranks and steps into one ordered stream.
    steps = upto.select(*keys, (F.col("_cum") - 1).alias("_r"), F.col("_x").alias("_x"),
                        F.lit(None).cast("int").alias("_i"), F.lit(None).cast("string").alias("_side"))
    wants = spot.select(*keys, F.col("_i"), F.explode(F.array(
        F.struct(F.col("_f").alias("_r"), F.lit("lo").alias("_side")),
        F.struct(F.col("_g").alias("_r"), F.lit("hi").alias("_side")))).alias("_w"))
    wants = wants.select(*keys, F.col("_w._r").alias("_r"), F.lit(None).cast("double").alias("_x"),
                         "_i", F.col("_w._side").alias("_side"))
    merged = carry(wants.unionByName(steps), keys,
                   [F.col("_r"), F.col("_x").isNotNull(), F.col("_i"), F.col("_side")],
                   ahead={"_hit": F.col("_x")})
    hits = merged.where("_side is not null").groupBy(*keys, "_i").agg(
        F.max(F.when(F.col("_side") == "lo", F.col("_hit"))).alias("_lo"),
        F.max(F.when(F.col("_side") == "hi", F.col("_hit"))).alias("_hi"))
    match = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"h.{k}")) for k in [*keys, "_i"]])
    solved = spot.alias("s").join(hits.alias("h"), match)
    q = F.col("h._lo") + (F.col("h._hi") - F.col("h._lo")) * (F.col("s._at") - F.col("s._f"))
    solved = solved.select(*[F.col(f"s.{k}").alias(k) for k in keys], F.col("s._i").alias("_i"), q.alias("_q"))
    per = solved.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_q"))).alias("_a"))
    per = per.withColumn("_a", F.transform("_a", lambda s: s["_q"]))
    wide = per.groupBy(*by).pivot("_name", list(values)).agg(F.first("_a", ignorenulls=True))
    empty = clean.groupBy(*by).agg(F.count(F.lit(1)).alias("_all")).drop("_all") if by else None
    if empty is None:
        return wide
    cond = reduce(lambda a, b: a & b, [F.col(f"e.{k}").eqNullSafe(F.col(f"w.{k}")) for k in by])
    return empty.alias("e").join(wide.alias("w"), cond, "left").select(
        *[F.col(f"e.{k}").alias(k) for k in by], *[F.col(f"w.{a}").alias(a) for a in values])


def grouped(
    df: DataFrame,
    by: Sequence[str],
    aggs: Sequence[Column],
    values: Mapping[str, Column],
    probs: Sequence[float],
    group_rows: int | None = None,
) -> DataFrame:
    """Ordinary aggregates and exact quantile arrays per group.

    Small groups take one aggregation for everything; large ones keep the aggregates map-side and
    join the quantiles, which are found without gathering a group.
    """
    from evenkeel.functions.numeric import finite_or_null
    from evenkeel.operators.summaries import attach

    if fits_one_task(df, by, group_rows):
        levels = F.array(*[F.lit(float(p)) for p in probs])
        return df.groupBy(*by).agg(
            *aggs, *[F.percentile(finite_or_null(c.cast("double")), levels).alias(a) for a, c in values.items()])
    return attach(df.groupBy(*by).agg(*aggs), quantiles(df, by, values, probs, 2**62), by)
