"""Signal injection, periodograms, and spectral model comparison on parameter grids."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evenkeel.functions.labels import warning_types
from evenkeel.functions.numeric import bound_hits, hash_uniform, is_finite, period_from_log_frequency
from evenkeel.operators.ordered import neighbours
from evenkeel.operators.quality import violations
from evenkeel.operators.summaries import attach
from evenkeel.operators.transform import dft
from evenkeel.session import discard, materialize, spread

# Signal generator constants.
PERIOD_MIN, PERIOD_MAX, MIN_CYCLES = 40.0, 300.0, 3.0
PEAK_EXCESS, PEAK_FRACTION, RISE_FRACTION, DECAY_FRACTION = 0.5, 0.20, 0.04, 0.30

# Frequency cutoff, parameters counted per model, and parameter bounds.
CUTOFF_HZ = 0.025
PENALTY = {"M0": 2, "M1": 5, "M2": 4}
BOUNDS: dict[str, tuple[tuple[float | None, float | None], ...]] = {
    "M0": ((-10.0, 10.0), (-1.0, 6.0), (-20.0, 10.0)),
    "M1": ((-10.0, 10.0), (-1.0, 6.0), (-20.0, 10.0), (-16.0, 5.0),
           (math.log(1.0 / 300.0), math.log(1.0 / 40.0)), (0.05, 0.25)),
    "M2": ((None, None), (1.0, 9.0), (0.0033, 0.25), (1.0, 9.0), (None, None)),
}
OPEN = (-10.0, 10.0)  # searched range where a bound is open
WIDTH = 6


# --- injection ---------------------------------------------------------------------------------

def period_limit(duration: Column) -> Column:
    """Longest admissible period: three cycles must fit; NULL when even the shortest does not."""
    top = F.least(F.lit(PERIOD_MAX), duration / MIN_CYCLES)
    return F.when(top >= PERIOD_MIN, top)


def draw_parameters(units: DataFrame, ident: str, duration: Column, salt: str) -> DataFrame:
    """Log-uniform period, phase and cycle count per unit, fixed by the unit's id and the salt."""
    u = hash_uniform(F.lit(f"{salt}:PERIOD"), F.col(ident).cast("string"))
    v = hash_uniform(F.lit(f"{salt}:PHASE"), F.col(ident).cast("string"))
    top = period_limit(duration)
    period = F.exp(F.log(F.lit(PERIOD_MIN)) + u * (F.log(top) - F.log(F.lit(PERIOD_MIN))))
    return units.withColumns({"true_period": period, "phase": v * (2.0 * math.pi)}).withColumn(
        "cycles", duration / F.col("true_period"))


def envelope(t: Column, duration: Column, peak_t: Column) -> Column:
    """Exponential rise to the peak and slower exponential decay after it."""
    rise, decay = duration * RISE_FRACTION, duration * DECAY_FRACTION
    return F.when(t <= peak_t, PEAK_EXCESS * F.exp((t - peak_t) / rise)).otherwise(
        PEAK_EXCESS * F.exp(-(t - peak_t) / decay))


def inject(series: DataFrame, params: DataFrame, ident: str, fraction: float) -> DataFrame:
    """Null and positive series over the same background.

    ``params(ident, duration, peak_t, true_period, phase)``. The null member is background plus
    envelope; the positive member adds ``fraction * envelope * sin(2 pi (t - peak) / P + phase)``.
    """
    rows = series.join(params, ident)
    env = envelope(F.col("t"), F.col("duration"), F.col("peak_t"))
    wave = F.lit(fraction) * env * F.sin(
        F.lit(2.0 * math.pi) * (F.col("t") - F.col("peak_t")) / F.col("true_period") + F.col("phase"))
    both = F.explode(F.array(
        F.struct(F.lit(False).alias("signal"), (F.col("y") + env).alias("v")),
        F.struct(F.lit(True).alias("signal"), (F.col("y") + env + wave).alias("v"))))
    return rows.select(ident, "idx", "t", both.alias("_m")).select(
        ident, "idx", "t", F.col("_m.signal").alias("signal"), F.col("_m.v").alias("y"))


# --- periodogram -------------------------------------------------------------------------------

def power_spectrum(series: DataFrame, by: Sequence[str], hann: bool = True, nyquist: bool = False) -> DataFrame:
    """Squared transform modulus at the positive frequencies: ``(by, k, freq, power)``.

    ``series`` carries ``pos`` = 0 .. n-1. Values are centred and scaled by the mean, and tapered
    with ``hann``. Series that are too long for one piece are transformed over many tasks.
    """
    s = series.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.avg("y").alias("_m"),
                                F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    s = materialize(s.where("_n > 1").withColumn("_span", (F.col("_t1") - F.col("_t0")) / (F.col("_n") - 1) * F.col("_n")))
    longest = s.agg(F.max("_n")).first()[0] or 0
    n, pos = F.col("_n"), F.col("pos")
    taper = 0.5 - 0.5 * F.cos(F.lit(2.0 * math.pi) * pos / (n - 1)) if hann else F.lit(1.0)
    last = F.floor(n / 2) if nyquist else F.floor((n - 1) / 2)
    rows = attach(series, s, by, "inner").withColumns({"_z": (F.col("y") - F.col("_m")) / F.col("_m") * taper, "_last": last})
    # the span rides along as a key, so that no join is needed for it afterwards
    out = dft(rows, [*by, "_span"], "_z", "pos", "_n", "_last", longest).where("k > 0")
    return out.select(*by, "k", (F.col("k") / F.col("_span")).alias("freq"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def periodogram(series: DataFrame, by: Sequence[str]) -> DataFrame:
    """Tapered power, divided by its mean and then by the standard deviation of the result."""
    p = materialize(power_spectrum(series, by))  # read twice
    s = p.groupBy(*by).agg(F.avg("power").alias("_a"), F.stddev_pop("power").alias("_d"))
    out = attach(p, s, by)
    scaled = F.col("power") / F.col("_a")
    return out.withColumn("power", F.when(F.col("_d") > 0, scaled / (F.col("_d") / F.col("_a")))).drop("_a", "_d")


def cut(spectrum: DataFrame, top: float = CUTOFF_HZ) -> DataFrame:
    return spectrum.where(F.col("freq") < top)


def bin_counts(spectrum: DataFrame, by: Sequence[str], top: float = CUTOFF_HZ) -> DataFrame:
    """Bins before and after the cutoff and the frequency range that is left."""
    left = F.col("freq") < top
    return spectrum.groupBy(*by).agg(
        F.count(F.lit(1)).alias("positive_bins"), F.count_if(left).alias("kept_bins"),
        F.min(F.when(left, F.col("freq"))).alias("lowest"), F.max(F.when(left, F.col("freq"))).alias("highest"))


def equal_pieces(series: DataFrame, by: Sequence[str], length: int) -> tuple[DataFrame, DataFrame]:
    """Realisations of equal length, and violations for series that are too short for one.

    Pieces follow each other from the first sample on; if a rest is left, one more piece holds the last ``length`` samples, so that every
    sample is read. Adds ``piece`` and ``pos``; ``idx`` is 0 .. n-1. A sample is in two pieces at most.
    """
    n = materialize(series.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")))
    short = violations(n.where(F.col("_n") < length), "series_shorter_than_piece", by, F.col("_n"))
    whole, at = F.expr(f"_n div {length}"), F.col("idx")
    place = lambda piece, pos: F.struct(piece.cast("bigint").alias("piece"), pos.cast("bigint").alias("pos"))
    own = F.when(F.expr(f"idx div {length}") < whole, place(F.expr(f"idx div {length}"), at % length))
    last = F.when((F.col("_n") % length > 0) & (at >= F.col("_n") - length), place(whole, at - (F.col("_n") - length)))
    rows = attach(series, n.where(F.col("_n") >= length), by, "inner").withColumn("_p", F.explode(F.array_compact(F.array(own, last))))
    return rows.select(*series.columns, "_p.*"), short


def ensemble_slope(spectra: DataFrame, by: Sequence[str], level: str, tolerance: float = 0.35) -> DataFrame:
    """Log-log slope of the mean power over realisations, against the expected ``-level``.

    ``ordered`` tells whether slopes fall strictly with rising level within ``by``.
    """
    mean = spectra.groupBy(*by, level, "freq").agg(F.avg("power").alias("p")).where("freq > 0 and p > 0")
    fit = mean.groupBy(*by, level).agg(F.count(F.lit(1)).alias("bins"), F.regr_slope(F.log("p"), F.log("freq")).alias("slope"))
    fit = fit.withColumn("error", F.abs(F.col("slope") + F.col(level)))
    steps = neighbours(fit, by, [F.col(level)], prev={"_before": F.col("slope")})
    flags = steps.groupBy(*by).agg(F.coalesce(F.bool_and(F.when(F.col("_before").isNotNull(), F.col("_before") > F.col("slope"))),
                                              F.lit(True)).alias("ordered"))
    return attach(fit, flags, by).withColumn("within_tolerance", F.col("error") <= tolerance)


# --- model grid --------------------------------------------------------------------------------

def axes(model: str, points: Sequence[int]) -> list[list[float]]:
    """Evenly spaced values inside the searched range of every parameter, ends included."""
    out = []
    for (lo, hi), n in zip(BOUNDS[model], points):
        lo, hi = (OPEN[0] if lo is None else lo), (OPEN[1] if hi is None else hi)
        out.append([lo + (hi - lo) * i / (n - 1) for i in range(n)])
    return out


MODELS = ("M0", "M1", "M2")


def grid_rows(points: Mapping[str, Sequence[int]]) -> list[tuple]:
    """(theta id, model number, a0..a5) of every grid point; unused parameters are zero."""
    rows = []
    for model, pts in points.items():
        for theta in itertools.product(*axes(model, pts)):
            rows.append((len(rows), MODELS.index(model), *theta, *[0.0] * (WIDTH - len(theta))))
    return rows


GRID_SCHEMA = "tid int, m int, " + ", ".join(f"a{i} double" for i in range(WIDTH))

THETA = tuple(f"a{i}" for i in range(WIDTH))

#: Bins of one block of a long series; blocks of which the first pass reads one in so many; digits within which likelihoods are equal.
BLOCK, FIRST, DIGITS = 4_096, 8, 6
#: Model values that a task holds at a time.
CELLS = 1 << 20


def model_power(m: int, theta: np.ndarray, freq: np.ndarray, fmin: float) -> np.ndarray:
    """Model values of parameter rows ``theta`` (rows) at ``freq`` (columns).

    Powers and bumps depend on one or two parameters, so they are computed once per different value.
    """
    def each(values: np.ndarray, of) -> np.ndarray:
        values = values + 0.0  # one zero
        kinds, at = np.unique(values, return_inverse=True)
        return of(kinds[:, None])[at.reshape(-1)]

    a = theta.T
    if m == 2:
        low = np.exp(a[0])[:, None] * each(a[1], lambda x: np.power(freq, -x))
        high = (np.exp(a[0]) * np.power(a[2], -a[1] + a[3]))[:, None] * each(a[3], lambda x: np.power(freq, -x))
        return np.where(freq < a[2][:, None], low, high) + np.exp(a[4])[:, None]
    base = np.exp(a[0])[:, None] * each(a[1], lambda x: np.power(freq / fmin, -x)) + np.exp(a[2])[:, None]
    if m == 1:
        shapes, at = np.unique(a[4:6].T, axis=0, return_inverse=True)
        bumps = np.exp(-0.5 * np.square((np.log(freq) - shapes[:, :1]) / shapes[:, 1:]))
        base += (np.exp(a[3]) / np.sqrt(2.0 * math.pi * a[5] * a[5]))[:, None] * bumps[at.reshape(-1)]
    return base


def _terms(m: int, theta: np.ndarray, freq: np.ndarray, power: np.ndarray, fmin: float) -> tuple[np.ndarray, np.ndarray]:
    """``ok`` (usable terms) and ``x`` (their sum) per parameter row: a term is ``ln s + power / s`` and needs a positive ``s``."""
    ok, x = np.zeros(len(theta), np.int64), np.zeros(len(theta))
    step = max(1, CELLS // max(len(freq), 1))
    with np.errstate(all="ignore"):
        for i in range(0, len(theta), step):
            s = model_power(m, theta[i:i + step], freq, fmin)
            bad = s <= 0
            terms = np.log(s) + power / s
            if bad.any():
                terms[bad] = 0.0
            ok[i:i + step], x[i:i + step] = len(freq) - bad.sum(1), terms.sum(1)
    return ok, x


def lattice_power(m: int, lattice: Sequence[np.ndarray], freq: np.ndarray, fmin: float) -> np.ndarray:
    """:func:`model_power` for all combinations of the parameter values in ``lattice``, one dimension each and the last for ``freq``."""
    shaped = lambda k, x: x.reshape([-1 if i == k else 1 for i in range(len(lattice))] + [1])
    a = [shaped(k, x) for k, x in enumerate(lattice)]
    if m == 2:
        low = np.exp(a[0]) * np.power(freq, -a[1])
        high = np.exp(a[0]) * np.power(a[2], -a[1] + a[3]) * np.power(freq, -a[3])
        return np.where(freq < a[2], low, high) + np.exp(a[4])
    base = np.exp(a[0]) * np.power(freq / fmin, -a[1]) + np.exp(a[2])
    if m == 1:
        base = base + np.exp(a[3]) / np.sqrt(2.0 * math.pi * a[5] * a[5]) * np.exp(-0.5 * np.square((np.log(freq) - a[4]) / a[5]))
    return base


def _leader(m: int, lattice: Sequence[np.ndarray], freq: np.ndarray, power: np.ndarray, fmin: float) -> tuple[list[float], float, int] | None:
    """The best combination of ``lattice`` (values in rising order), its likelihood, and how many share it (see :func:`_best`).

    The first parameter is walked value by value, so that a task holds the combinations of the others at a time.
    """
    sums = []
    with np.errstate(all="ignore"):
        for first in lattice[0]:
            s = lattice_power(m, [np.array([first]), *lattice[1:]], freq, fmin).reshape(-1, len(freq))
            x = (np.log(s) + power / s).sum(1)
            least = s.min(1)
            x[least <= 0] = np.nan  # the logarithm has no value there
            sums.append(x)
    lnl = -np.concatenate(sums)
    use = np.isfinite(lnl)
    if not use.any():
        return None
    level = np.where(np.abs(lnl) < 1e9, np.round(lnl, DIGITS), lnl)
    top = np.flatnonzero(use & (level == level[use].max()))
    at = np.unravel_index(top[0], [len(x) for x in lattice])  # combinations are in order of their parameters
    return [float(x[i]) for x, i in zip(lattice, at)], float(lnl[top[0]]), len(top)


def _ends(m: int, lattice: Sequence[np.ndarray], fmin: float, fmax: float) -> tuple[int, int]:
    """Points of the grid whose value is not positive, or not finite, at an end of the frequency range."""
    with np.errstate(all="ignore"):
        s = lattice_power(m, lattice, np.array([fmin, fmax]), fmin)
    return int((s <= 0).sum()), int((~np.isfinite(s)).sum())


def _bin_lists(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Frequencies and powers of every row of the list column ``_b``."""
    column = batch.column("_b")
    flat, cuts = column.flatten(), column.offsets.to_numpy() - column.offsets[0].as_py()
    freq, power = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
    for i, j in zip(cuts[:-1], cuts[1:]):
        yield freq[i:j], power[i:j]


def _keyed(rows: DataFrame, by: Sequence[str], added: str, run) -> DataFrame:
    """``run(batch)`` gives (row of the batch, added values ...); the rows' ``by`` columns ride along."""
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = StructType([rows.schema[c] for c in by] + StructType.fromDDL(added).fields)
    wanted = to_arrow_schema(schema)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at, values in run(part):
                own = [part.column(c).take(pa.array(at, pa.int64())).cast(wanted.field(c).type) for c in by]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(v, f.type) for v, f in zip(values, list(wanted)[len(by):])]], schema=wanted)

    return rows.mapInArrow(batches, schema)


FIT = "m int, bins bigint, " + ", ".join(f"{c} double" for c in THETA) + ", lnl double, ties bigint"
ODD = "m int, non_positive bigint, overflow bigint"
POINT_SUMS = "tid int, m int, " + ", ".join(f"{c} double" for c in THETA) + ", bins bigint, ok bigint, x double"
POINT_LIST = "struct<tid:int,m:int," + ",".join(f"{c}:double" for c in THETA) + ">"


def _fit_short(rows: DataFrame, by: Sequence[str], points: Mapping[str, Sequence[int]], refine: int) -> DataFrame:
    """Best rows with ``non_positive`` and ``overflow``, from one row per series ``(by, fmin, fmax, _b)``; nothing is shuffled."""
    grids = _lattices(points)

    def run(batch: pa.RecordBatch):
        at, out = [], []
        ends = zip(batch.column("fmin").to_pylist(), batch.column("fmax").to_pylist())
        for row, ((freq, power), (fmin, fmax)) in enumerate(zip(_bin_lists(batch), ends)):
            for m, lattice in grids.items():
                best = _leader(m, lattice, freq, power, fmin)
                for step in range(refine):
                    if best is not None:
                        best = _leader(m, _near(m, best[0], lattice, 2.0 ** -(step + 1)), freq, power, fmin)
                if best is not None:
                    at.append(row)
                    out.append((m, len(freq), *best[0], *[0.0] * (WIDTH - len(lattice)), best[1], best[2], *_ends(m, lattice, fmin, fmax)))
        if at:
            yield at, list(zip(*out))

    return _keyed(rows, by, FIT + ", " + ODD.split(", ", 1)[1], run)


def _odd(size: DataFrame, by: Sequence[str], points: Mapping[str, Sequence[int]]) -> DataFrame:
    """``non_positive`` and ``overflow`` per series and model of ``size(by, fmin, fmax)``."""
    grids = _lattices(points)

    def run(batch: pa.RecordBatch):
        ends = list(zip(batch.column("fmin").to_pylist(), batch.column("fmax").to_pylist()))
        out = [(m, *_ends(m, lattice, *pair)) for pair in ends for m, lattice in grids.items()]
        if out:
            yield [i for i in range(len(ends)) for _ in grids], list(zip(*out))

    return _keyed(size, by, ODD, run)


def _best(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """The best parameter row per series and model, and how many different ones share its likelihood (``ties``).

    Likelihoods are equal within ``DIGITS`` decimals; of equal rows the one of the smallest parameters is taken.
    """
    g = sums.where((F.col("ok") == F.col("bins")) & is_finite(F.col("x"))).select(*by, "m", "bins", *THETA, (-F.col("x")).alias("lnl"))
    theta = F.struct(*THETA)
    level = g.groupBy(*by, "m", F.round("lnl", DIGITS).alias("_l")).agg(
        F.min_by(F.struct("bins", "lnl", *THETA), theta).alias("_b"), F.size(F.collect_set(theta)).alias("ties"))
    return level.groupBy(*by, "m").agg(F.max_by(F.struct("_b", "ties"), "_l").alias("_t")).select(*by, "m", "_t._b.*", "_t.ties")


def _block_sums(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums over each block ``(by, fmin, _b, _p)`` for its parameter rows ``_p``; parameters ride along as plain numbers."""
    def run(batch: pa.RecordBatch):
        column = batch.column("_p")
        flat, cuts = column.flatten(), column.offsets.to_numpy() - column.offsets[0].as_py()
        tid, ms = flat.field("tid").to_numpy(), flat.field("m").to_numpy()
        theta = np.stack([flat.field(c).to_numpy() for c in THETA], axis=1)
        for row, ((freq, power), fmin, i, j) in enumerate(zip(_bin_lists(batch), batch.column("fmin").to_pylist(), cuts[:-1], cuts[1:])):
            ok, x = np.zeros(j - i, np.int64), np.zeros(j - i)
            for m in np.unique(ms[i:j]):
                own = ms[i:j] == m
                ok[own], x[own] = _terms(int(m), theta[i:j][own], freq, power, fmin)
            yield np.full(j - i, row), [tid[i:j], ms[i:j], *theta[i:j].T, np.full(j - i, len(freq)), ok, x]

    return _keyed(blocks, by, POINT_SUMS, run)


def _sums(blocks: DataFrame, points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums over all bins for the parameter rows that can still be best; ``points(by, tid, m, a0..a5)``.

    A series lies in blocks ``(by, blocks, blk, fmin, floor, _b)``, dealt to many tasks, with its points copied to each. The first
    pass reads one block in ``FIRST`` for every point. A term ``ln s + p / s`` is at least ``1 + ln p``, so what the first
    pass has of a point plus that bound over the other blocks (``floor``) is a lower bound of its sum. The point that leads
    after the first pass is summed in full, and only points whose bound does not exceed that sum are read on; all
    that tie with the best are among them.
    """
    keys = list(by)
    sizes = blocks.select(*keys, "blocks", "blk")
    at = [*keys, "blk"]
    opening = F.col("blk") % FIRST == 0
    add = lambda df: df.groupBy(*keys, "tid").agg(F.sum("bins").alias("bins"), F.sum("ok").alias("ok"), F.sum("x").alias("x"), *[F.max(c).alias(c) for c in ("m", *THETA)])

    def read(which: Column, pts: DataFrame) -> DataFrame:
        own = pts.groupBy(*keys).agg(F.collect_list(F.struct("tid", "m", *THETA).cast(POINT_LIST)).alias("_p"))
        some = blocks.where(which).join(own.join(sizes.where(which), keys).select(*at, "_p"), at)
        return add(_block_sums(some.select(*keys, "fmin", "_b", "_p"), keys))

    none = F.lit(0).cast("bigint")
    unread = points.select(*keys, "tid", "m", *THETA, none.alias("bins"), none.alias("ok"), F.lit(0.0).alias("x"))  # a short series may have no opening block
    begun = materialize(add(read(opening, points).select(*keys, "tid", "m", *THETA, "bins", "ok", "x").unionByName(unread)))
    usable = begun.where((F.col("ok") == F.col("bins")) & is_finite(F.col("x")))
    point = ["tid", "m", *THETA]
    lead = usable.groupBy(*keys, "m").agg(F.min_by(F.struct("tid", *THETA), F.struct("x", "tid")).alias("_p"), F.min("x").alias("_x0")).select(*keys, "m", "_p.*", "_x0")
    led = read(~opening, lead.drop("_x0")).select(*keys, "m", F.col("x").alias("_x1"), (F.col("ok") == F.col("bins")).alias("_whole"))
    floor = blocks.where(~opening).groupBy(*keys).agg(F.sum("floor").alias("_floor"))
    goal = (lead.select(*keys, "m", "_x0").join(led, [*keys, "m"], "left").join(floor, keys, "left")
            .select(*keys, "m", F.when(F.col("_whole") & is_finite(F.col("_x1")), F.col("_x0") + F.col("_x1")).otherwise(F.when(F.col("_floor").isNull(), F.col("_x0"))
                                                                                                                    .otherwise(F.lit(float("inf")))).alias("_goal"),
                    F.coalesce("_floor", F.lit(0.0)).alias("_floor")))
    slack = 10.0 ** -DIGITS + 1e-9 * F.abs(F.col("_goal"))
    alive = materialize(usable.join(goal, [*keys, "m"]).where(F.col("x") + F.col("_floor") <= F.col("_goal") + slack).select(*keys, *point, "bins", "ok", "x"))
    done = materialize(add(read(~opening, alive.select(*keys, *point)).select(*keys, *point, "bins", "ok", "x").unionByName(alive)))
    discard(begun, alive)
    return done


def fit_grid(spectra: DataFrame, by: Sequence[str], points: Mapping[str, Sequence[int]], refine: int = 1,
             group_rows: int | None = None, block: int = BLOCK) -> DataFrame:
    """Best grid parameters, log-likelihood and BIC per series and model, with what was odd about the fit.

    The grid is a constant of the plan and does not grow with the data. Series of at most a block of bins are
    placed by series once and fitted in that task, refinements included, so that no point leaves it; if any is longer, all lie
    in blocks (see :func:`_sums`). Each refinement crosses a series' best row with a fixed local grid of half the last spacing, clipped to the bounds.
    A null key is left out of refinements.

    ``ties`` counts the parameter rows of the last grid that reach the best likelihood; ``non_positive`` and ``overflow``
    count points of the first grid whose model value is not positive, or not finite, at an end of the frequency range.
    """
    spark = spectra.sparkSession
    keys = list(by)
    told = materialize(spectra.where(is_finite(F.col("power"))).select(*by, "freq", "power"))
    longest = told.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    bins = F.collect_list(F.struct("freq", "power")).alias("_b")
    if longest <= (block if group_rows is None else group_rows):
        rows = told.dropna(subset=keys) if refine else told
        each = spread(rows, *by).groupBy(*by).agg(F.min("freq").alias("fmin"), F.max("freq").alias("fmax"), bins)
        out = _fit_short(each, by, points, refine)
    else:
        size = materialize(told.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("freq").alias("fmin"), F.max("freq").alias("fmax"))
                           .withColumn("blocks", F.ceil(F.col("_n") / block).cast("bigint")))
        least = F.sum(F.when(F.col("power") > 0, 1.0 + F.log("power")).otherwise(F.lit(float("-inf")))).alias("floor")
        rows = attach(told, size.select(*by, "blocks", "fmin"), by, "inner").withColumn("blk", F.pmod(F.xxhash64("freq"), F.col("blocks")))
        blocks = materialize(rows.groupBy(*by, "blocks", "blk", "fmin").agg(least, bins))
        models = F.explode(F.array(*[F.lit(MODELS.index(m)) for m in points])).alias("m")
        theta = spark.createDataFrame(grid_rows(points), GRID_SCHEMA)
        best = _best(_sums(blocks, size.select(*by, models).join(F.broadcast(theta), "m"), by), by)
        for step in range(refine):
            local = spark.createDataFrame(_offsets(points, 2.0 ** -(step + 1)), GRID_SCHEMA)
            local = local.select("tid", "m", *[F.col(f"a{i}").alias(f"_o{i}") for i in range(WIDTH)])
            near = spread(best, *by).join(F.broadcast(local), "m").select(*by, "tid", "m", *[_clip(i).alias(f"a{i}") for i in range(WIDTH)])
            best = _best(_sums(blocks, near, by), by)
        out = attach(best, _odd(size, by, points), [*keys, "m"])
    names = F.element_at(F.array(*[F.lit(n) for n in MODELS]), F.col("m") + 1)
    weight = F.element_at(F.array(*[F.lit(float(PENALTY[n])) for n in MODELS]), F.col("m") + 1)
    out = out.withColumns({"model": names, "bic": -2.0 * F.col("lnl") + weight * F.log("bins")})
    return out.select(*by, "model", "bins", "lnl", "bic", *THETA, "ties", "non_positive", "overflow")


def _lattices(points: Mapping[str, Sequence[int]]) -> dict[int, list[np.ndarray]]:
    """The axes of every model's grid, by model number."""
    return {MODELS.index(model): [np.array(x) for x in axes(model, pts)] for model, pts in points.items()}


def _near(m: int, best: Sequence[float], lattice: Sequence[np.ndarray], scale: float) -> list[np.ndarray]:
    """The axes of the local grid around ``best``: what :func:`_offsets` and :func:`_clip` give, each combination once."""
    out = []
    for x, ax, (lo, hi) in zip(best, lattice, BOUNDS[MODELS[m]]):
        width = (ax[-1] - ax[0]) / max(len(ax) - 1, 1) * scale
        moved = np.array([x - width, x, x + width])
        out.append(np.unique(moved if lo is None and hi is None else np.clip(moved, lo, hi)))
    return out


def _offsets(points: Mapping[str, Sequence[int]], scale: float) -> list[tuple]:
    rows = []
    for model, pts in points.items():
        width = [(ax[-1] - ax[0]) / max(len(ax) - 1, 1) * scale for ax in axes(model, pts)]
        for way in itertools.product((-1, 0, 1), repeat=len(pts)):
            rows.append((len(rows), MODELS.index(model), *[w * d for w, d in zip(width, way)], *[0.0] * (WIDTH - len(pts))))
    return rows


def _clip(i: int) -> Column:
    moved = F.col(f"a{i}") + F.col(f"_o{i}")
    out = F.lit(0.0)
    for model, bounds in BOUNDS.items():
        if i < len(bounds):
            lo, hi = bounds[i]
            x = moved if lo is None else F.greatest(moved, F.lit(lo))
            x = x if hi is None else F.least(x, F.lit(hi))
            out = F.when(F.col("m") == MODELS.index(model), x).otherwise(out)
    return out


def fit_warnings() -> Column:
    """Warnings of a fit as an array of (category, message)."""
    told = lambda when, category, message: F.when(when, F.struct(F.lit(category).alias("category"), message.alias("message")))
    count = lambda c, text: F.concat(F.col(c).cast("string"), F.lit(text))
    return F.array_compact(F.array(
        told(F.col("non_positive") > 0, "NonPositiveModel", count("non_positive", " model values at the ends of the range")),
        told(F.col("overflow") > 0, "Overflow", count("overflow", " model values at the ends of the range")),
        told(F.col("ties") > 1, "TieOfBestPoints", count("ties", " parameter rows"))))


def fit_status(fits: DataFrame) -> DataFrame:
    """Status, parameters on their bounds, warnings, and the period of the bump model's centre."""
    hits = F.array().cast("array<struct<parameter_index:int,side:string,value:double,bound:double>>")
    for model, bounds in BOUNDS.items():
        found = bound_hits([F.col(f"a{i}") for i in range(len(bounds))], bounds)
        hits = F.when(F.col("model") == model, found).otherwise(hits)
    return fits.withColumns({
        "status": F.when(is_finite(F.col("bic")), "OK").otherwise("ERROR"),
        "bound_hits": hits, "at_bound": F.size(hits) > 0, **warning_types(fit_warnings()),
        "period": F.when(F.col("model") == "M1", period_from_log_frequency(F.col("a4")))})


def score_table(fits: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fits as the (key, model, score) rows that trio assembly takes."""
    return fits.select(*by, "model", F.col("bic").alias("score"), "at_bound", "warning_count", "status", "period")
