"""Hierarchical nearest matching without replacement.

References choose in key order; each takes the closest free candidate at the first level
that has one (same target and sector, same target, same sector, any), ties to the smaller
candidate key. Read as preferences, that is serial dictatorship, and deferred acceptance
reaches the same pairs in parallel: every unmatched reference proposes to its best candidate
that is free or held by a later reference, and every candidate keeps its earliest proposer.

No reference is ever paired with a whole group. Candidates of a group get positions in
rising and in falling order of value; a reference knows how many candidates lie below it, and
looks outward through a few positions on each side per round, joining on ``(level, group,
side, position)``. The window doubles while nothing acceptable is found, so no partner is
ever cut off.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from evenkeel.functions.numeric import is_finite
from evenkeel.operators.ordered import number_rows, running_sum
from evenkeel.plans.expansion import surrogate_ids
from evenkeel.session import broadcast_rows_limit, discard, materialize

LEVELS = (("SAME_TIC_SAME_SECTOR", ("tic", "sector")), ("SAME_TIC_ANY_SECTOR", ("tic",)),
          ("SAME_SECTOR", ("sector",)), ("GLOBAL_ALLOWED_SECTOR_POOL", ()))
FIRST_WINDOW = 8


def _groups(levels: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Array of (level, group text) that a row belongs to; a NULL is a value of its own."""
    return F.array(*[F.struct(F.lit(i).alias("lv"), F.concat_ws("\u001f", F.lit(""), *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols]).alias("grp"))
                     for i, (_, cols) in enumerate(levels)])


def _places(refs: DataFrame, pool: DataFrame, levels) -> tuple[DataFrame, DataFrame]:
    """Candidate positions per (level, group), and where each reference stands in them."""
    g = pool.select("cand", "value", "second", "tie", F.explode(_groups(levels)).alias("_g")).select("cand", "value", "second", "tie", "_g.*")
    g = number_rows(g, ["lv", "grp"], [F.col("value"), F.col("cand")], "up")
    g = ranked = materialize(number_rows(g, ["lv", "grp"], [F.col("value").desc(), F.col("cand")], "down"))
    sides = F.explode(F.array(F.struct(F.lit("R").alias("side"), F.col("up").alias("pos")),
                              F.struct(F.lit("L").alias("side"), F.col("down").alias("pos"))))
    table = materialize(g.select("lv", "grp", "cand", "value", "second", "tie", sides.alias("_s")).select(
        "lv", "grp", "_s.*", "cand", F.col("value").alias("cvalue"), F.col("second").alias("csecond"), "tie"))
    r = refs.select("ref", "value", F.explode(_groups(levels)).alias("_g")).select("ref", "value", "_g.*")
    both = r.select("lv", "grp", "value", F.lit(0).alias("n"), "ref").unionByName(
        g.select("lv", "grp", "value", F.lit(1).alias("n"), F.col("cand").alias("ref")))
    below = running_sum(both, ["lv", "grp"], [F.col("value"), F.col("n"), F.col("ref")], {"below": F.col("n")}).where("n = 0")
    size = g.groupBy("lv", "grp").agg(F.count(F.lit(1)).alias("size"))
    spots = below.join(size, ["lv", "grp"]).select("ref", "lv", "grp", "below", "size")
    spots = materialize(spots)
    discard(ranked)
    return table, spots


def _seek(active: DataFrame, spots: DataFrame, table: DataFrame, held: DataFrame, exact_ties: bool) -> DataFrame:
    """Look through the next window on both sides; one row per reference with what was found."""
    at = active.join(spots, ["ref", "lv"], "left")
    at = at.withColumns({"below": F.coalesce("below", F.lit(0)), "size": F.coalesce("size", F.lit(0))})
    room = {"R": F.col("size") - F.col("below"), "L": F.col("below")}
    skip = {"R": F.col("below"), "L": F.col("size") - F.col("below")}
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"off_{s}").alias("off"), room[s].alias("room"), skip[s].alias("skip"))
    look = at.select("ref", "value", "second", "lv", "grp", "k", F.explode(F.array(side("R"), side("L"))).alias("_s")).select(
        "ref", "value", "second", "lv", "grp", "k", "_s.*").where("off < room")
    look = look.withColumn("o", F.explode(F.sequence(F.col("off") + 1, F.least(F.col("off") + F.col("k"), F.col("room")))))
    look = look.withColumn("pos", F.col("skip") + F.col("o"))
    seen = look.join(table, ["lv", "grp", "side", "pos"]).join(held, "cand", "left")
    d = F.abs(F.col("cvalue") - F.col("value"))
    d2 = F.abs(F.col("csecond") - F.col("second"))
    seen = seen.withColumns({"d": d, "d2": F.coalesce(d2, F.lit(0.0)), "ok": F.col("holder").isNull() | (F.col("holder") > F.col("ref"))})
    on = lambda s: F.col("side") == s
    aggs = []
    for s in ("R", "L"):
        aggs += [F.min(F.when(on(s) & F.col("ok"), F.struct("d", "d2", "tie", "cand", "cvalue"))).alias(f"best_{s}"),
                 F.min(F.when(on(s) & F.col("ok"), F.col("o"))).alias(f"first_{s}"),
                 F.max(F.when(on(s), F.col("d"))).alias(f"edge_{s}"), F.max(F.when(on(s), F.col("o"))).alias(f"last_{s}")]
    found = seen.groupBy("ref").agg(*aggs)
    out = at.join(found, "ref", "left")
    for s in ("R", "L"):
        ended = (F.col(f"off_{s}") >= room[s]) | (F.coalesce(F.col(f"last_{s}"), F.lit(0)) >= room[s])
        out = out.withColumn(f"ended_{s}", ended)
    best = F.when(F.col("best_L").isNull() | (F.col("best_R") < F.col("best_L")), F.col("best_R")).otherwise(F.col("best_L"))
    out = out.withColumn("best", best)

    def settled(s: str) -> Column:
        beyond = F.coalesce(F.col(f"edge_{s}") > F.col("best.d"), F.lit(False))
        own = F.lit(False) if exact_ties else F.col(f"best_{s}").isNotNull()
        return F.col(f"ended_{s}") | beyond | own

    ready = F.col("best").isNotNull() & settled("R") & settled("L")
    dead = F.col("best").isNull() & F.col("ended_R") & F.col("ended_L")
    mirror = F.when(F.col("best_R.d") == F.col("best_L.d"),
                    F.when(F.col("best") == F.col("best_R"), F.col("best_L.cvalue")).otherwise(F.col("best_R.cvalue")))
    moved = {f"off_{s}": F.coalesce(F.col(f"first_{s}") - 1, F.col(f"last_{s}"), F.col(f"off_{s}")) for s in ("R", "L")}
    # Offsets stand just before the first acceptable position: what lies behind has refused for good.
    return out.select(
        "ref", "value", "second",
        F.when(dead, F.col("lv") + 1).otherwise(F.col("lv")).alias("lv"),
        F.when(dead | ready, F.lit(FIRST_WINDOW)).otherwise(F.col("k") * 2).alias("k"),
        *[F.when(dead, 0).otherwise(c).cast("bigint").alias(a) for a, c in moved.items()],
        F.when(ready, F.col("best.cand")).alias("wish"), F.when(ready, F.col("best.d")).alias("d"),
        F.when(ready, F.col("best.cvalue")).alias("cvalue"), F.when(ready, mirror).alias("mirror"))


def _head_start(refs: DataFrame, pool: DataFrame, levels, second: bool) -> DataFrame:
    """How many candidates of exactly its value a reference may pass over before it starts.

    References of one group and value want the same candidates in the same order. The j-th of them
    cannot get any of the first j - 1 candidates of distance zero: the earlier ones take those or
    better. Without this, many copies would lose to one another one round at a time.
    """
    if second:
        return refs.withColumn("_skip", F.lit(0).cast("bigint"))
    cols = [c for c in levels[0][1]]
    r = number_rows(refs, [*cols, "value"], [F.col("ref")], "_nth")
    same = pool.groupBy(*cols, "value").agg(F.count(F.lit(1)).alias("_same"))
    return r.join(same, [*cols, "value"], "left").withColumn(
        "_skip", F.least(F.col("_nth") - 1, F.coalesce("_same", F.lit(0).cast("bigint"))))


STATE = ("ref", "value", "second", "lv", "k", "off_R", "off_L")
SEEK, PAIR, LOST = "SEEK", "PAIR", "LOST"


def match_without_replacement(refs: DataFrame, pool: DataFrame, levels=LEVELS, audit: bool = True,
                              second: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """Pairs ``(ref, cand, level, difference, ...)``, one row per reference, unmatched ones included.

    ``refs(ref, value, level columns)``, ``pool(cand, value, level columns)``; ``ref`` and ``cand``
    are keys in choosing order. With ``second`` both carry a second value whose distance breaks ties
    of the first; ``tie`` names columns of the pool whose order breaks ties of both, before the key. ``audit`` adds how many
    candidates and ties were open at the reference's turn.

    Levels that share columns (the first ones, as target and sector, target) are solved group by group inside tasks, and only
    references that find nothing there go through rounds (:func:`_near_first`). That needs whole values, keys that occur once and
    groups of at most ``NEAR_ROWS`` rows; otherwise all references go through the rounds (:func:`_rounds`). Both give the same pairs.
    """
    if not second:
        refs, pool = (x.withColumn("second", F.lit(None).cast("double")) for x in (refs, pool))
    pool = pool.withColumn("tie", F.struct(*tie) if tie else F.struct(F.lit(0).alias("none")))
    refs, pool = materialize(refs), materialize(pool)
    base, near = _near_levels(levels)
    if near and not (audit and second) and _plain(refs, pool, base, second):
        done = _near_first(refs, pool, levels, base, near, audit, second or bool(tie), second)
    else:
        done = _rounds(refs, pool, levels, audit, second, tie)
    discard(refs, pool)
    return done


def _rounds(refs: DataFrame, pool: DataFrame, levels, audit: bool, second: bool, tie: Sequence[str]) -> DataFrame:
    """All references in rounds.

    A round writes only references that still seek or whose pair may still be broken. A pair whose reference comes before
    all that still seek is settled: it stays where it was written last and is only read from then on. All copies are deleted at the end.
    """
    table, spots = _places(refs, pool, levels)
    zero = F.lit(0).cast("bigint")
    kinds = {"cand": dict(pool.dtypes)["cand"], "d": "double", "cvalue": "double", "mirror": "double"}
    unpaired = lambda df, what: df.select(*STATE, *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()], F.lit(what).alias("what"))
    step = materialize(unpaired(_head_start(refs, pool, levels, second or bool(tie)).select(
        "ref", "value", "second", F.lit(0).alias("lv"), F.lit(FIRST_WINDOW).alias("k"), F.col("_skip").alias("off_R"), zero.alias("off_L")), SEEK))
    steps, settled = [step], []
    while (first := step.where(F.col("what") == SEEK).agg(F.min("ref")).first()[0]) is not None:
        final = F.col("ref") < F.lit(first)
        settled.append(step.where((F.col("what") == LOST) | ((F.col("what") == PAIR) & final)))
        active, held = step.where(F.col("what") == SEEK).select(*STATE), step.where((F.col("what") == PAIR) & ~final).drop("what")
        taken = held.select("cand", "ref")
        for part in settled:
            taken = taken.unionByName(part.where("cand is not null").select("cand", "ref"))
        sought = materialize(_seek(active, spots, table, taken.withColumnRenamed("ref", "holder"), second or bool(tie)))
        winners = sought.where("wish is not null").groupBy(F.col("wish").alias("cand")).agg(F.min("ref").alias("ref"))
        after = sought.join(winners.select("ref", F.lit(True).alias("_won")), "ref", "left")
        won = after.where("_won").select(*STATE, F.col("wish").alias("cand"), "d", "cvalue", "mirror", F.lit(PAIR).alias("what"))
        on = unpaired(after.where("_won is null"), SEEK).withColumn("what", F.when(F.col("lv") < len(levels), SEEK).otherwise(LOST))
        beaten = held.join(winners.select("cand", F.lit(True).alias("_lost")), "cand", "left")
        stays = beaten.where("_lost is null").select(*STATE, *kinds, F.lit(PAIR).alias("what"))
        step = materialize(won.unionByName(on).unionByName(stays).unionByName(unpaired(beaten.where("_lost"), SEEK)))
        steps.append(step)
        discard(sought)
    state = step.drop("what")
    for part in settled:
        state = state.unionByName(part.drop("what"))
    name = F.element_at(F.array(*[F.lit(n) for n, _ in levels]), F.col("lv") + 1)
    hit = F.col("cand").isNotNull()
    out = state.select("ref", "cand", F.when(hit, name).otherwise("UNMATCHED").alias("level"), "value", F.col("cvalue").alias("cand_value"),
                       F.col("d").alias("difference"),
                       F.when(hit, "MATCHED_WITHOUT_REPLACEMENT").otherwise("UNMATCHED_REFERENCE").alias("status"))
    if audit:
        out = _audit(out, state, spots, table, levels)
    done = materialize(out)
    discard(table, spots, *steps)
    return done


#: Rows of a group that one task solves by itself; references of equal wishes that choose one after the other within a round.
NEAR_ROWS, TURNS = 2_000, 512


def _near_levels(levels) -> tuple[list[str], int]:
    """Columns that the first levels share, and how many levels do."""
    base, near = [], 0
    for i, (_, cols) in enumerate(levels):
        if cols and all(set(cols) <= set(c) for _, c in levels[:i]):
            base, near = list(cols), i + 1
    return base, near


def _plain(refs: DataFrame, pool: DataFrame, base: Sequence[str], second: bool) -> bool:
    """Whether all values are numbers, keys occur once and groups are small."""
    whole = F.lit(True)
    for c in ("value", "second")[:1 + second]:
        whole &= is_finite(F.col(c).cast("double"))
    for df, key in ((refs, "ref"), (pool, "cand")):
        odd = df.where(F.col(key).isNull() | ~F.coalesce(whole, F.lit(False)))
        if not odd.isEmpty() or not df.groupBy(key).count().where("count > 1").isEmpty():
            return False
    sizes = refs.select(*base).unionByName(pool.select(*base)).groupBy(*base).count()
    return sizes.where(F.col("count") > NEAR_ROWS).isEmpty()


def _solve_groups(groups: DataFrame, inner: Sequence[Sequence[str]], keys: tuple[str, str], second: bool) -> DataFrame:
    """Choices within groups ``(refs, cands, outside)``: a row per reference, ``cand`` NULL where nothing was free.

    Both lists are in choosing order; ``outside`` tells which candidates went to references from elsewhere.
    """
    schema = f"ref {keys[0]}, lv int, cand {keys[1]}, value double, d double, cvalue double, candidates bigint, ties bigint"

    def run(batches):
        for batch in batches:
            out = []
            for refs, cands, outside in zip(*(batch.column(c).to_pylist() for c in ("refs", "cands", "outside"))):
                gone = {x["cand"]: x["ref"] for x in outside or ()}
                free = [c for c in cands or ()]
                for r in refs:
                    open_ = [c for c in free if c["cand"] not in gone or gone[c["cand"]] > r["ref"]]
                    row = (r["ref"], None, None, r["value"], None, None, 0, 0)
                    for lv, cols in enumerate(inner):
                        here = [c for c in open_ if all(c[x] == r[x] for x in cols)]
                        if here:
                            away = [(abs(c["value"] - r["value"]), abs(c["second"] - r["second"]) if second else 0.0) for c in here]
                            at = min(range(len(here)), key=away.__getitem__)  # the first of equal ones
                            d = away[at][0]
                            row = (r["ref"], lv, here[at]["cand"], r["value"], d, here[at]["value"], len(here), sum(a == d for a, _ in away))
                            free.remove(here[at])
                            break
                    out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*out) if out else [()] * len(wanted), wanted)], schema=wanted)

    wanted = to_arrow_schema(_parse_datatype_string(schema))
    return groups.mapInArrow(run, schema)


def _far_places(refs: DataFrame, pool: DataFrame, far) -> tuple[DataFrame, DataFrame]:
    """Candidates with their positions in rising and falling order per (level, group), and where references stand.

    ``far`` lists ``(lv, columns, run)``. A run holds the candidates of exactly the reference's value, in order of the second value.
    """
    text = lambda cols, run: F.concat_ws("\u001f", F.lit(""), *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols],
                                         *([(F.col("value") + F.lit(0.0)).cast("string")] if run else []))
    groups = F.explode(F.array(*[F.struct(F.lit(lv).alias("lv"), text(cols, run).alias("grp"), F.col("second" if run else "value").cast("double").alias("v"))
                                 for lv, cols, run in far])).alias("_g")
    g = pool.select("cand", "value", "second", "tie", groups).select("cand", "value", "second", "tie", "_g.*")
    g = number_rows(g, ["lv", "grp"], [F.col("v"), F.col("tie"), F.col("cand")], "up")
    g = materialize(number_rows(g, ["lv", "grp"], [F.col("v").desc(), F.col("tie"), F.col("cand")], "down"))
    r = refs.select("ref", groups).select("ref", "_g.*")
    both = r.select("lv", "grp", "v", F.lit(0).alias("n"), "ref").unionByName(g.select("lv", "grp", "v", F.lit(1).alias("n"), F.col("cand").cast(refs.schema["ref"].dataType).alias("ref")))
    below = running_sum(both, ["lv", "grp"], [F.col("v"), F.col("n"), F.col("ref")], {"below": F.col("n")}).where("n = 0")
    size = g.groupBy("lv", "grp").agg(F.count(F.lit(1)).alias("size"))
    return g, materialize(below.join(size, ["lv", "grp"]).select("ref", "lv", "grp", "below", "size"))


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` broadcast, if that many rows are few."""
    return F.broadcast(df) if rows <= 5 * broadcast_rows_limit(df.sparkSession) else df


def _pick(exact: dict[int, bool], key: str, cand: str):
    """References of equal wishes take turns: each passes over what an earlier one asks for in the same round."""
    schema = (f"ref {key}, found_R bigint, found_L bigint, last_R bigint, last_L bigint, wish {cand}, d double, cvalue double, mirror double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, asked = [], set()
        ties = exact[int(pdf.lv.iloc[0])]
        for ref, own in pdf.sort_values(["ref", "nth"]).groupby("ref", sort=True):
            side, best, done, first, last = {}, {}, {}, {}, {}
            for s in "RL":
                rows = own[own.side == s]
                last[s] = int(rows.o.max()) if len(rows) else None
                ok = rows[rows.ok]
                first[s] = int(ok.o.min()) if len(ok) else None
                ok = ok[~ok.cand.isin(asked)]
                best[s] = ok.loc[ok.nth.idxmin()] if len(ok) else None
                edge = rows.d.max() if len(rows) else None
                ended = bool(own[f"ended_{s}"].iloc[0])
                side[s] = (ended, edge)
            both = [b for b in best.values() if b is not None]
            wish = (None,) * 4
            if both:
                top = min(both, key=lambda b: b.nth)
                done = [side[s][0] or (side[s][1] is not None and side[s][1] > top.d) or (not ties and best[s] is not None) for s in "RL"]
                if all(done):
                    other = best["L" if top.side == "R" else "R"]
                    wish = (top.cand, top.d, top.cvalue, other.cvalue if other is not None and other.d == top.d else None)
                    asked.add(top.cand)
            out.append((ref, first["R"], first["L"], last["R"], last["L"], *wish))
        return pd.DataFrame(out, columns=["ref", "found_R", "found_L", "last_R", "last_L", "wish", "d", "cvalue", "mirror"]).astype(
            {c: "Int64" for c in ("found_R", "found_L", "last_R", "last_L")})
    return run, schema


def _far_seek(active: DataFrame, count: int, width: int, spots: DataFrame, table: DataFrame, taken: DataFrame, exact: dict[int, bool]) -> DataFrame:
    """One round of a few references: look through the next window on both sides, then take turns among equal wishes."""
    at = spots.join(_few(active, count), ["ref", "lv"]).select(*active.columns, "grp", "below", "size")
    at = materialize(active.join(at.select("ref", "grp", "below", "size"), "ref", "left").withColumns(
        {"below": F.coalesce("below", F.lit(0).cast("bigint")), "size": F.coalesce("size", F.lit(0).cast("bigint"))}).withColumns(
        {"ended_R": F.col("off_R") + F.col("k") >= F.col("size") - F.col("below"), "ended_L": F.col("off_L") + F.col("k") >= F.col("below")}))
    side = lambda s, room, skip: F.struct(F.lit(s).alias("side"), F.col(f"off_{s}").alias("off"), room.alias("room"), skip.alias("skip"))
    low, high = F.col("below"), F.col("size") - F.col("below")
    look = at.select("ref", "lv", "grp", "k", F.explode(F.array(side("R", high, low), side("L", low, high))).alias("_s")).select(
        "ref", "lv", "grp", "k", "_s.*").where("off < room")
    look = look.withColumn("o", F.explode(F.sequence(F.col("off") + 1, F.least(F.col("off") + F.col("k"), F.col("room")))))
    look = look.select("ref", "lv", "grp", "side", (F.col("skip") + F.col("o")).alias("pos"), "o")
    sides = table.select("lv", "grp", "cand", "tie", F.col("value").alias("cvalue"), F.col("second").alias("csecond"),
                         F.explode(F.array(F.struct(F.lit("R").alias("side"), F.col("up").alias("pos")), F.struct(F.lit("L").alias("side"), F.col("down").alias("pos")))).alias("_s"))
    sides = sides.select("lv", "grp", "cand", "tie", "cvalue", "csecond", "_s.*")
    rows = 2 * width * count
    seen = materialize(sides.join(_few(look, rows), ["lv", "grp", "side", "pos"]))
    wanted = seen.select("cand").distinct()
    holder = taken.join(_few(wanted, rows), "cand", "left_semi").groupBy("cand").agg(F.min("ref").alias("holder"))
    seen_ = seen.join(holder, "cand", "left").join(at.select("ref", "value", "second", "ended_R", "ended_L"), "ref")
    d2 = F.coalesce(F.abs(F.col("csecond") - F.col("second")), F.lit(0.0))
    seen_ = seen_.withColumns({"d": F.abs(F.col("cvalue") - F.col("value")), "d2": d2, "ok": F.col("holder").isNull() | (F.col("holder") > F.col("ref"))})
    seen_ = seen_.withColumn("nth", F.row_number().over(Window.partitionBy("ref").orderBy("d", "d2", "tie", "cand")))
    turns = number_rows(at, ["lv", "grp", "value", "second"], [F.col("ref")], "_turn").select("ref", F.floor((F.col("_turn") - 1) / TURNS).alias("turn"))
    seen_ = seen_.join(turns, "ref").select("lv", "grp", "value", "second", "turn", "ref", "side", "o", "cand", "cvalue", "d", "ok", "nth", "ended_R", "ended_L")
    run, schema = _pick(exact, dict(active.dtypes)["ref"], dict(table.dtypes)["cand"])
    found = seen_.groupBy("lv", "grp", "value", "second", "turn").applyInPandas(run, schema)
    out = at.join(found, "ref", "left")
    ready = F.col("wish").isNotNull()
    dead = F.col("found_R").isNull() & F.col("found_L").isNull() & F.col("ended_R") & F.col("ended_L")
    moved = {f"off_{s}": F.coalesce(F.col(f"found_{s}") - 1, F.col(f"last_{s}"), F.col(f"off_{s}")) for s in ("R", "L")}
    # All that a side holds may have been asked for by others in this round: then the same window is looked at again.
    stuck = F.col("ended_R") & F.col("ended_L")
    done = materialize(out.select(
        "ref", "value", "second", F.when(dead, F.col("lv") + 1).otherwise(F.col("lv")).alias("lv"),
        F.when(dead | ready, F.lit(FIRST_WINDOW)).when(stuck, F.col("k")).otherwise(F.col("k") * 2).alias("k"),
        *[F.when(dead, 0).otherwise(c).cast("bigint").alias(a) for a, c in moved.items()], "wish", "d", "cvalue", "mirror"))
    discard(at, seen)
    return done


def _near_first(refs: DataFrame, pool: DataFrame, levels, base: list[str], near: int, audit: bool, ties: bool, second: bool) -> DataFrame:
    """Groups of the first levels are solved in tasks; those that find nothing there go through rounds over the other levels.

    Proposals may come in any order, so the result is that of :func:`_rounds`. A group is solved anew when a candidate
    of it goes to a reference from elsewhere; a candidate's holder only ever moves to earlier references, so it is the smallest of all it had.
    """
    kinds = dict(refs.dtypes)["ref"], dict(pool.dtypes)["cand"]
    inner = [[c for c in cols if c not in base] for _, cols in levels[:near]]
    more = sorted({c for cols in inner for c in cols})
    b = [F.col(c).alias(f"_b{i}") for i, c in enumerate(base)]
    by = [f"_b{i}" for i in range(len(base))]
    r = F.struct("ref", "value", "second", *more)
    c = F.struct("tie", "cand", "value", "second", *more)
    packed = refs.select(*b, r.alias("r"), F.lit(None).cast(pool.select(c.alias("c")).schema["c"].dataType).alias("c")).unionByName(
        pool.select(*b, F.lit(None).cast(refs.select(r.alias("r")).schema["r"].dataType).alias("r"), c.alias("c")))
    strip = F.transform(F.array_sort(F.collect_list("c")), lambda x: F.struct(x["cand"].alias("cand"), x["value"].alias("value"), x["second"].alias("second"),
                                                                              *[x[m].alias(m) for m in more]))
    packed = packed.groupBy(*by).agg(F.array_sort(F.collect_list("r")).alias("refs"), strip.alias("cands")).where(F.size("refs") > 0)
    packed = materialize(packed.withColumn("gid", F.xxhash64(*by)).drop(*by))  # groups of one hash are told apart by their candidates
    outside_none = F.lit(None).cast(f"array<struct<cand:{kinds[1]},ref:{kinds[0]}>>").alias("outside")
    solve = lambda groups: _solve_groups(groups, inner, kinds, second)
    local = materialize(solve(packed.select("refs", "cands", outside_none)))
    owner = pool.select("cand", F.xxhash64(*base).alias("gid"))
    far = []
    for name, cols in levels[near:]:
        far += ([(name, cols, True)] if second else []) + [(name, cols, False)]
    names = [n for n, _ in levels[:near]] + [n for n, _, _ in far]
    places = [(near + i, cols, run) for i, (_, cols, run) in enumerate(far)]
    exact = {lv: ties and not run for lv, _, run in places}
    state_cols = {"cand": kinds[1], "d": "double", "cvalue": "double", "mirror": "double"}
    unpaired = lambda df, what: df.select(*STATE, *[F.lit(None).cast(k).alias(n) for n, k in state_cols.items()], F.lit(what).alias("what"))
    zero = F.lit(0).cast("bigint")
    fresh = lambda rows: unpaired(rows.select("ref", "value", "second", F.lit(near).alias("lv"), F.lit(FIRST_WINDOW).alias("k"), zero.alias("off_R"), zero.alias("off_L")),
                                  SEEK if far else LOST)
    step = materialize(fresh(refs.join(local.where("cand is null").select("ref"), "ref", "left_semi")))
    table, spots = _far_places(refs, pool, places) if far else (None, None)
    history, steps, wins = [local], [step], None
    while (told := step.where(F.col("what") == SEEK).agg(F.count(F.lit(1)), F.max("k")).first())[0]:
        count, width = told
        active, held = step.where(F.col("what") == SEEK).select(*STATE), step.where(F.col("what") == PAIR).drop("what")
        lost = step.where(F.col("what") == LOST)
        taken = held.select("cand", "ref")
        for part in history:
            taken = taken.unionByName(part.where("cand is not null").select("cand", "ref"))
        sought = _far_seek(active, count, width, spots, table, taken, exact)
        winners = sought.where("wish is not null").groupBy(F.col("wish").alias("cand")).agg(F.min("ref").alias("ref"))
        after = sought.join(winners.select("ref", F.lit(True).alias("_won")), "ref", "left")
        won = after.where("_won").select(*STATE, F.col("wish").alias("cand"), "d", "cvalue", "mirror", F.lit(PAIR).alias("what"))
        on = unpaired(after.where("_won is null"), SEEK).withColumn("what", F.when(F.col("lv") < len(names), SEEK).otherwise(LOST))
        beaten = held.join(winners.select("cand", F.lit(True).alias("_lost")), "cand", "left")
        stays = beaten.where("_lost is null").select(*STATE, *state_cols, F.lit(PAIR).alias("what"))
        step = materialize(won.unionByName(on).unionByName(stays).unionByName(lost).unionByName(unpaired(beaten.where("_lost"), SEEK)))
        gone = _outside(step, owner, count)
        hit = owner.join(_few(winners.select("cand"), count), "cand", "left_semi").select("gid").distinct()
        again = packed.join(_few(hit, count), "gid", "left_semi").join(gone, "gid", "left").select("refs", "cands", "outside")
        anew = materialize(solve(again))
        history.append(anew)
        out = anew.where("cand is null").select("ref").distinct().join(step.select("ref"), "ref", "left_anti")
        grown = materialize(step.unionByName(fresh(refs.join(F.broadcast(out) if count <= NEAR_ROWS else out, "ref", "left_semi"))))
        discard(sought)
        steps += [step, grown]
        step = grown
    last = solve(packed.join(_outside(step, owner, None), "gid", "left").select("refs", "cands", "outside")).where("cand is not null")
    final = materialize(last)
    tell = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("lv") + 1)
    hit = F.col("cand").isNotNull()
    shape = ["ref", "cand", F.when(hit, tell).otherwise("UNMATCHED").alias("level"), "value", F.col("cvalue").alias("cand_value"), F.col("d").alias("difference"),
             F.when(hit, "MATCHED_WITHOUT_REPLACEMENT").otherwise("UNMATCHED_REFERENCE").alias("status")]
    state = step.drop("what")
    elsewhere = state.select(*shape)
    own = final.select(*shape, *(["candidates", "ties"] if audit else []))
    if audit:
        if far:
            sided = table.select("lv", "grp", F.lit("R").alias("side"), "cand", F.col("value").alias("cvalue"))
            pairs = state.where("cand is not null").select("cand", "ref").unionByName(final.select("cand", "ref"))
            elsewhere = _audit(elsewhere, state, spots, sided, levels, pairs)
        else:
            elsewhere = elsewhere.withColumns({"candidates": zero, "ties": zero})
    done = materialize(own.unionByName(elsewhere))
    discard(packed, *history, *steps, final, *([table, spots] if far else []))
    return done


def _outside(step: DataFrame, owner: DataFrame, count: int | None) -> DataFrame:
    """Per group the candidates that references from elsewhere hold."""
    pairs = step.where("cand is not null").select("cand", "ref")
    pairs = pairs if count is None else _few(pairs, 0) if step.count() <= broadcast_rows_limit(step.sparkSession) else pairs
    return owner.join(pairs, "cand").groupBy("gid").agg(F.collect_list(F.struct("cand", "ref")).alias("outside"))


def _earlier(questions: DataFrame, taken: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Per question, how many taken candidates of its group went to an earlier reference."""
    q = questions.select(*by, "ref", F.lit(0).alias("n"))
    t = taken.select(*by, "ref", F.lit(1).alias("n"))
    both = q.unionByName(t)
    return running_sum(both, by, [F.col("ref"), F.col("n")], {name: F.col("n")}).where("n = 0").select(*by, "ref", name)


def _audit(out: DataFrame, state: DataFrame, spots: DataFrame, table: DataFrame, levels, pairs: DataFrame | None = None) -> DataFrame:
    """Open candidates and open ties at each reference's turn, from group sizes less earlier takings."""
    done = state.where("cand is not null").select("ref", "lv", "cand", "cvalue", "mirror")
    mine = done.join(spots.select("ref", "lv", "grp", "size"), ["ref", "lv"])
    one_side = table.where("side = 'R'").select("lv", "grp", "cand", "cvalue")
    taken = materialize(one_side.join(done.select("cand", "ref") if pairs is None else pairs, "cand"))
    gone = _earlier(mine, taken, ["lv", "grp"], "gone")
    open_n = mine.join(gone, ["lv", "grp", "ref"]).select("ref", (F.col("size") - F.col("gone")).alias("candidates"))
    asks = mine.select("ref", "lv", "grp", F.explode(F.array_compact(F.array("cvalue", "mirror"))).alias("cvalue"))
    total = one_side.groupBy("lv", "grp", "cvalue").agg(F.count(F.lit(1)).alias("all"))
    by = ["lv", "grp", "cvalue"]
    tie = asks.join(total, by).join(_earlier(asks, taken, by, "went"), [*by, "ref"])
    ties = tie.groupBy("ref").agg(F.sum(F.col("all") - F.col("went")).alias("ties"))
    zero = F.lit(0).cast("bigint")
    return out.join(open_n, "ref", "left").join(ties, "ref", "left").withColumns(
        {"candidates": F.coalesce("candidates", zero), "ties": F.coalesce("ties", zero)})


def pair_manifest(matches: DataFrame) -> DataFrame:
    """Two rows per matched pair, in reference order, each with its partner's id."""
    ok = matches.where("cand is not null")
    ids = surrogate_ids(matches.select("ref"), [F.col("ref")], "P", 4, "pair_id")
    pairs = number_rows(ok.select("ref", "cand", "level"), [], [F.col("ref")], "_n")
    pairs = pairs.join(ids, "ref")
    code = lambda c: F.concat(F.lit("E"), F.lpad(c.cast("string"), 6, "0"))
    a, b = code(F.col("_n") * 2 - 1), code(F.col("_n") * 2)
    left = pairs.select(a.alias("event_id"), "pair_id", F.col("ref").alias("event_key"), F.lit("REFERENCE").alias("role"),
                        b.alias("partner_id"), "level", F.lit("ALL_REFERENCES").alias("reason"))
    right = pairs.select(b.alias("event_id"), "pair_id", F.col("cand").alias("event_key"), F.lit("COMPARISON").alias("role"),
                         a.alias("partner_id"), "level", F.lit("ONE_TO_ONE_WITHOUT_REPLACEMENT").alias("reason"))
    return left.unionByName(right)
