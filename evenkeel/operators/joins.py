"""Lookup, range, nearest and reconciliation joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.ordered import carry, neighbours
from evenkeel.operators.quality import violations
from evenkeel.session import broadcast_rows_limit

TIE_TOLERANCE = 1e-15


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a few narrow columns of a measured number of rows; otherwise Spark shuffles and AQE splits skew."""
    return F.broadcast(df) if rows <= broadcast_rows_limit(df.sparkSession) else df


def unique_lookup(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Child rows joined to their only parent, and violations for missing or ambiguous keys.

    Parents are first reduced to one row per key, so the join cannot multiply child rows.
    """
    rest = [c for c in parent.columns if c not in keys]
    heads = parent.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*rest)).alias("_p"))
    joined = child.join(heads, list(keys), "left")
    good = joined.where("_n = 1").select(*child.columns, "_p.*")
    bad = joined.where("_n is null or _n > 1")
    kind = F.when(F.col("_n").isNull(), "missing_parent").otherwise("ambiguous_parent")
    bad = bad.groupBy(*keys, kind.alias("_kind")).agg(F.count(F.lit(1)).alias("_c"))
    out = violations(bad, "lookup", keys, F.concat_ws("|", "_kind", "_c"))
    return good, out


def _level(length: Column, at: Column) -> Column:
    """Exponent of the smallest power of two that is at least the length; very short intervals share a level near their place."""
    return F.ceil(F.log2(F.greatest(length, F.greatest(F.abs(at), F.lit(1.0)) * 2.0**-20))).cast("int")


def _interval_join(events: DataFrame, intervals: DataFrame, t: str, inside: Column, lo: str, hi: str) -> DataFrame:
    """Left join of points to intervals as an equi-join on time buckets; a point has one row per level at least.

    The bucket width of an interval is the power of two above its length, so it touches two buckets at most
    whatever the lengths of the others; a point looks once into each width that occurs.
    """
    sized = intervals.where(F.col(lo) <= F.col(hi)).withColumn("_lv", _level(F.col(hi) - F.col(lo), F.col(lo)))
    levels = [r["_lv"] for r in sized.select("_lv").distinct().collect()] or [0]  # exponents: some dozens
    rows = 2 * sized.count()
    width = F.pow(F.lit(2.0), F.col("_lv"))
    wide = sized.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    points = events.withColumn("_lv", F.explode(F.array(*map(F.lit, levels)))).withColumn("_b", F.floor(F.col(t) / width))
    wide = maybe_broadcast(wide, rows)
    return points.join(wide, (points["_lv"] == wide["_lv"]) & (points["_b"] == wide["_b"]) & inside, "left").drop("_b", "_lv")


#: Most boundaries that are searched as a constant of the plan.
SMALL_SIDE = 4_096


def _last_at_or_before(sorted_values: Sequence[float], t: Column) -> Column:
    """How many of the ascending ``sorted_values`` are at most ``t``: a bisection in a column expression, with no join."""
    values = F.lit([float(v) for v in sorted_values])
    steps = F.lit([1 << k for k in range(len(sorted_values).bit_length() - 1, -1, -1)])
    here = lambda n, step: F.coalesce(F.get(values, n + step - 1) <= t, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(here(n, step), n + step).otherwise(n))


def partition_join(events: DataFrame, boundaries: DataFrame, t: str, bound: str, part: str,
                   group_rows: int | None = None, small: int = SMALL_SIDE) -> DataFrame:
    """Latest boundary at or before ``t`` whose successor lies after ``t``, with the margin to the nearer edge.

    ``part`` and ``margin`` stay NULL before the first and from the last boundary on, and where ``t`` is not finite. Of boundaries
    at the same place the one of the largest ``part`` counts. Up to ``small`` boundaries are a constant of the plan, searched where
    the events lie. More are merged with the events into one time order, in which each event takes the last boundary seen.
    """
    heads = boundaries.where(F.col(bound).isNotNull()).groupBy(F.col(bound).cast("double").alias("_lo")).agg(F.max(part).alias(part))
    few = heads.limit(small + 1).collect()
    if len(few) <= small:
        few = sorted(few, key=lambda r: r["_lo"])
        kind = boundaries.schema[part].dataType
        if len(few) < 2:
            return events.select(*events.columns, F.lit(None).cast(kind).alias(part), F.lit(None).cast("double").alias("margin"))
        at = F.col(t).cast("double")
        lows = F.lit([r["_lo"] for r in few])
        found = events.withColumn("_i", F.when(at.isNotNull() & ~F.isnan(at), _last_at_or_before([r["_lo"] for r in few], at)))
        inside = F.col("_i").between(1, len(few) - 1)
        names = F.array(*[F.lit(r[part]).cast(kind) for r in few])
        out = found.withColumns({"_p": F.when(inside, F.get(names, F.col("_i") - 1)),
                                 "_d": F.when(inside, F.least(at - F.get(lows, F.col("_i") - 1), F.get(lows, F.col("_i")) - at))})
        return out.select(*events.columns, F.col("_p").alias(part), F.col("_d").alias("margin"))
    steps = neighbours(heads, [], [F.col("_lo")], next={"_hi": F.col("_lo")}).where("_hi is not null")
    marks = steps.select(F.col("_lo").alias("_t"), F.lit(0).alias("_kind"), F.struct("_lo", "_hi", part).alias("_s"))
    rows = events.select(F.col(t).cast("double").alias("_t"), F.lit(1).alias("_kind"), F.struct(*events.columns).alias("_m"))
    seen = carry(marks.unionByName(rows, allowMissingColumns=True), [], [F.col("_t"), F.col("_kind"), F.to_json("_m")],
                 back={"_l": F.col("_s")}, group_rows=group_rows).where("_kind = 1")
    at, step = F.col(f"_m.{t}"), F.when(F.col("_t") < F.col("_l._hi"), F.col("_l"))
    out = seen.withColumn("_h", step)
    return out.select(*[F.col(f"_m.{c}").alias(c) for c in events.columns], F.col(f"_h.{part}").alias(part),
                      F.least(at - F.col("_h._lo"), F.col("_h._hi") - at).alias("margin"))


def containment_join(events: DataFrame, intervals: DataFrame, key: Sequence[str], t: str, start: str, end: str,
                     name: str) -> DataFrame:
    """The one closed interval that holds ``t`` per event, its match count, NULL when there is none.

    More than one match leaves the name NULL; the count tells the caller.
    """
    slim = intervals.select(F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(name).alias("_name"))
    inside = F.col(t).between(F.col("_s"), F.col("_e"))
    hits = _interval_join(events.select(*key, t), slim, t, inside, "_s", "_e")
    return hits.groupBy(*key, t).agg(F.count("_name").alias("matches"), F.max("_name").alias("_m")).select(
        *key, t, "matches", F.when(F.col("matches") == 1, F.col("_m")).alias(name))


def nearest_join(markers: DataFrame, samples: DataFrame, by: Sequence[str], t: str = "t", idx: str = "idx",
                 tol: float = TIE_TOLERANCE, extra: Sequence[str] = (), group_rows: int | None = None) -> DataFrame:
    """Sample of smallest time distance per marker; ties go to the lowest index.

    Markers and samples of a group are merged into one time order, where the nearest sample is
    the last one before or the first one after: exact at any distance and linear in the rows.
    Samples of equal time are reduced to their lowest index beforehand. A marker without a finite time has no sample.
    """
    pick = F.min(F.struct(F.col(idx).alias("idx"), *extra)).alias("_s")
    ok = samples.where(F.col(t).isNotNull() & ~F.isnan(F.col(t)) & (F.abs(F.col(t)) < float("inf")))
    s = ok.groupBy(*by, t).agg(pick)
    s = s.select(*by, t, F.struct(F.col(t).alias("t"), F.col("_s.*")).alias("_s") if extra else
                 F.struct(F.col(t).alias("t"), F.col("_s.idx").alias("idx")).alias("_s"),
                 F.lit(0).alias("_kind"))
    rest = [c for c in markers.columns if c not in (*by, t)]
    m = markers.withColumn("_m", F.struct(*rest) if rest else F.struct(F.lit(1).alias("_1")))
    m = m.select(*by, t, "_m", F.lit(1).alias("_kind"))
    both = s.unionByName(m, allowMissingColumns=True)
    seen = carry(both, by, [F.col(t), F.col("_kind"), F.to_json("_m")], back={"_l": F.col("_s")},
                 ahead={"_r": F.col("_s")}, group_rows=group_rows).where("_kind = 1")
    dl, dr = F.abs(F.col(t) - F.col("_l.t")), F.abs(F.col("_r.t") - F.col(t))
    left = (F.when(F.col("_r").isNull(), True).when(F.col("_l").isNull(), False)
            .when(F.abs(dl - dr) <= tol, F.col("_l.idx") < F.col("_r.idx")).otherwise(dl < dr))
    hit = F.when(left, F.col("_l")).otherwise(F.col("_r"))
    known = F.col(t).isNotNull() & ~F.isnan(F.col(t)) & (F.abs(F.col(t)) < float("inf"))
    out = seen.withColumn("_h", F.when(known, hit))
    return out.select(*by, t, *[F.col(f"_m.{c}") for c in rest], F.col("_h.idx").alias("idx"),
                      *[F.col(f"_h.{c}") for c in extra], (F.col("_h.t") - F.col(t)).alias("residual"))


def neighbour_audit(markers: DataFrame, samples: DataFrame, by: Sequence[str], tol: float, t: str = "t",
                    idx: str = "idx", group_rows: int | None = None) -> DataFrame:
    """Nearest sample with its two neighbours, and how many of the three lie within ``tol`` of the marker."""
    around = neighbours(samples.select(*by, t, idx), by, [F.col(t), F.col(idx)], prev={"prev_t": F.col(t)},
                        next={"next_t": F.col(t)}, group_rows=group_rows)
    hit = nearest_join(markers, around, by, t, idx, extra=("prev_t", "next_t"), group_rows=group_rows)
    near = F.col(t) + F.col("residual")
    dist = lambda c: F.when(F.abs(c - F.col(t)) <= tol, 1).otherwise(0)
    hits = (dist(near) + dist(F.col("prev_t")) + dist(F.col("next_t"))).cast("bigint")
    return hit.withColumns({"tolerance_hits": hits, "unique_hit": hits == 1})


def reconcile(left: DataFrame, right: DataFrame, key: Sequence[str], fields: Sequence[str],
              tol: float = 0.0) -> DataFrame:
    """Cell-by-cell differences of two copies of a table.

    One row per differing field (NULL equals NULL, doubles within ``tol``) and one row per key
    that only one copy has (``field`` is ``*row*``).
    """
    l = left.select(*key, *[F.col(f).alias(f"_l_{f}") for f in fields], F.lit(True).alias("_in_l"))
    r = right.select(*key, *[F.col(f).alias(f"_r_{f}") for f in fields], F.lit(True).alias("_in_r"))
    both = l.join(r, list(key), "full_outer")
    types = dict(left.dtypes)

    def differs(f: str) -> Column:
        a, b = F.col(f"_l_{f}"), F.col(f"_r_{f}")
        if tol and types[f] in ("double", "float"):
            return ~F.coalesce(F.abs(a - b) <= tol, a.eqNullSafe(b))
        return ~a.eqNullSafe(b)

    text = lambda c: F.col(c).cast("string")
    cells = F.array_compact(F.array(*[
        F.when(differs(f), F.struct(F.lit(f).alias("field"), text(f"_l_{f}").alias("left"), text(f"_r_{f}").alias("right")))
        for f in fields]))
    lone = F.array(F.struct(F.lit("*row*").alias("field"), F.when(F.col("_in_l"), "present").alias("left"),
                            F.when(F.col("_in_r"), "present").alias("right")))
    paired = F.col("_in_l").isNotNull() & F.col("_in_r").isNotNull()
    return both.select(*key, F.explode(F.when(paired, cells).otherwise(lone)).alias("_d")).select(*key, "_d.*")


def replay_diff(first: DataFrame, second: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Per shared key the fields whose values differ, in declared order, and an overall flag."""
    a = first.select(*key, F.struct(*fields).alias("_a"))
    b = second.select(*key, F.struct(*fields).alias("_b"))
    diff = F.array_compact(F.array(*[F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.lit(f)) for f in fields]))
    out = a.join(b, list(key)).select(*key, F.array_join(diff, "|").alias("differing"))
    return out.withColumn("exact", F.col("differing") == "")


def variant_invariance(results: DataFrame, name: str, pairs: Sequence[tuple[str, str]], key: Sequence[str],
                       fields: Sequence[str]) -> DataFrame:
    """Passed and total keys per pair of named variants that should agree on every field."""
    tag = lambda side: F.array_compact(F.array(*[
        F.when(F.col(name) == p[side], F.lit(f"{p[0]}={p[1]}")) for p in pairs]))
    keys = [*key, "definition"]
    a = results.withColumn("definition", F.explode(tag(0)))
    b = results.withColumn("definition", F.explode(tag(1)))
    both = replay_diff(a.select(*keys, *fields), b.select(*keys, *fields), keys, fields)
    return both.groupBy("definition").agg(F.count(F.lit(1)).alias("total"), F.count_if("exact").alias("passed"),
                                          F.bool_and("exact").alias("invariant"))


def drop_repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop every row of a key that occurs more than once."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*rest)).alias("_r"))
    return one.where("_n = 1").select(*keys, "_r.*").select(*df.columns)


def best_candidates(candidates: DataFrame, keys: Sequence[str], version: Column, uri: str) -> DataFrame:
    """One row per key: highest version, then smallest URI; repeated URIs count once."""
    rest = [c for c in candidates.columns if c not in keys]
    down = F.transform(version, lambda v: -v)
    one = candidates.withColumn("_k", F.struct(down.alias("v"), F.col(uri).alias("u")))
    return one.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_k").alias("_r"),
                                  F.countDistinct(uri).alias("candidates")).select(*keys, "_r.*", "candidates")


def orphans(df: DataFrame, others: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows whose key is in none of the other frames."""
    return reduce(lambda a, o: a.join(o[0].select(*o[1]).distinct(), list(o[1]), "left_anti"), others, df)


