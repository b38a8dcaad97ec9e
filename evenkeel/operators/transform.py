"""Discrete Fourier transforms of many series, long ones split over tasks.

A series of ``n = n1 * n2`` values is transformed in two steps with one shuffle between them: values that lie ``n2`` apart form
pieces of ``n1``, which are transformed and turned by the twiddle factors; the results of equal frequency form pieces of
``n2``. Series of at most ``PIECE`` values are one piece and need the first step only. A length without a
balanced split (a prime, say) is transformed as a convolution with a chirp, whose length is a power of two.

Rows stay flat: pieces are put together from sorted rows, so that a task holds one piece and one batch, and a series of n values
has at most 2 n rows in each of its steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from evenkeel.session import materialize, shuffle_parts

#: Longest series that is transformed in one piece.
PIECE = 1 << 16
#: A split is balanced if its longer side has at most this many times the square root of the length.
LOPSIDED = 64


def _split_columns(n: Column, piece: int) -> tuple[Column, Column]:
    """``n1`` and ``n2``: the whole length and 1 for short series, else the divisors nearest to the square root."""
    low = F.array_max(F.filter(F.sequence(F.lit(1).cast("bigint"), F.floor(F.sqrt(n)).cast("bigint")), lambda d: n % d == 0))
    n2 = F.when(n <= piece, F.lit(1).cast("bigint")).otherwise(low)
    return (n / n2).cast("bigint"), n2


def _pieces(rows: DataFrame, by: Sequence[str], turn: bool) -> DataFrame:
    """Transform the pieces of ``rows(by, n, part, size, stride, top, at, re, im)``, unset places count as zero.

    Returns ``(by, n, stride, top, part, q, re, im)`` for every frequency ``q`` of a piece; with ``turn`` times the twiddle
    factor of (part, q). Frequencies ``part + stride * q`` beyond ``top`` are left out.
    """
    keys = [*by, "part"]
    out_schema = StructType([f for f in rows.schema.fields if f.name not in ("size", "at", "re", "im")]).add("q", LongType()).add("re", DoubleType()).add("im", DoubleType())
    from pyspark.sql.pandas.types import to_arrow_schema
    wanted = to_arrow_schema(out_schema)
    kept = [f.name for f in wanted if f.name not in ("q", "re", "im")]
    dealt = rows.repartition(shuffle_parts(rows.sparkSession), *keys).sortWithinPartitions(*keys, "at")

    def solved(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        column = lambda c: table.column(c).to_numpy()
        at, z = column("at"), column("re") + 1j * column("im")
        n, part, size, stride, top = (column(c)[cuts[:-1]] for c in ("n", "part", "size", "stride", "top"))
        first, q, values = [], [], []
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            x = np.zeros(size[i], complex)
            x[at[a:b]] = z[a:b]
            x = np.fft.fft(x)[:max(0, (top[i] - part[i]) // stride[i] + 1)]
            k = np.arange(len(x))
            if turn:
                x = x * np.exp(-2j * math.pi * ((part[i] * k) % n[i]) / n[i])
            first.append(np.full(len(x), a))
            q.append(k)
            values.append(x)
        first, q, values = np.concatenate(first), np.concatenate(q), np.concatenate(values)
        cols = [table.column(c).take(pa.array(first)).combine_chunks() for c in kept]
        cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
        made = {"q": pa.array(q), "re": pa.array(np.ascontiguousarray(values.real)), "im": pa.array(np.ascontiguousarray(values.imag))}
        return pa.RecordBatch.from_arrays([made.get(f.name) if f.name in made else cols[kept.index(f.name)].cast(f.type) for f in wanted], schema=wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def boundaries(batch: pa.RecordBatch) -> np.ndarray:
            """Rows of the batch at which another piece begins."""
            change = np.zeros(len(batch), bool)
            change[1:] = batch.column("at").to_numpy()[1:] <= batch.column("at").to_numpy()[:-1]
            for c in keys:
                told = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy()
                change[1:] |= told[1:] != told[:-1]
            return np.flatnonzero(change)

        same = lambda x, y: all(x.column(c)[len(x) - 1].as_py() == y.column(c)[0].as_py() for c in keys)
        for batch in batches:
            if not len(batch):
                continue
            if held and not same(held[-1], batch):
                table = pa.Table.from_batches(held)
                yield solved(table, np.asarray([0, len(table)]))
                held = []
            cuts = boundaries(batch)
            if len(cuts):
                table = pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))])
                shift = len(table) - int(cuts[-1])
                yield solved(table, np.concatenate([[0], cuts + shift]))
                held, batch = [], batch.slice(int(cuts[-1]))
            held.append(batch)
        if held:
            table = pa.Table.from_batches(held)
            yield solved(table, np.asarray([0, len(table)]))

    return dealt.mapInArrow(run, out_schema)


def _transform(rows: DataFrame, by: Sequence[str], long: bool, forward: bool = True) -> DataFrame:
    """``(by, n, k, re, im)`` of ``rows(by, n, n1, n2, top, j, re, im)`` for ``k <= top``; ``long``: there may be series with two steps."""
    if not forward:
        rows = rows.withColumn("im", -F.col("im"))
    one = F.lit(1).cast("bigint")
    step = rows.select(*by, "n", "n1", "n2", F.when(F.col("n2") == 1, F.col("top")).otherwise(F.col("n")).alias("top"), F.col("top").alias("last"),
                       (F.col("j") % F.col("n2")).alias("part"), F.col("n1").alias("size"), one.alias("stride"), F.expr("j div n2").alias("at"), "re", "im")
    done = _pieces(step, by, turn=True)
    cols = [*by, "n", "k", "re", "im"]
    short = done.where("n2 = 1").withColumn("k", F.col("q"))
    if not long:
        out = short.select(*cols)
    else:
        done = materialize(done)  # read by both branches
        rest = done.where("n2 > 1").select(*by, "n", "n1", "n2", F.col("last").alias("top"), "last", F.col("part").alias("at"), F.col("n2").alias("size"),
                                           F.col("n1").alias("stride"), F.col("q").alias("part"), "re", "im")
        both = _pieces(rest, by, turn=False).withColumn("k", F.col("part") + F.col("stride") * F.col("q"))
        out = done.where("n2 = 1").withColumn("k", F.col("q")).select(*cols).unionByName(both.select(*cols))
    return out if forward else out.withColumns({"re": F.col("re") / F.col("n"), "im": -F.col("im") / F.col("n")})


def dft(values: DataFrame, by: Sequence[str], value: str, position: str, length: str, top: str, longest: int | None = None,
        piece: int = PIECE, lopsided: float = LOPSIDED) -> DataFrame:
    """``(by, k, re, im)``: sums of ``value * exp(-2 pi i k j / n)`` for ``k = 0 .. top``.

    ``position`` is ``j = 0 .. n - 1`` and ``length`` is ``n``, the same in all rows of a series, as ``top``. A missing position
    counts as zero, a null value makes its series NaN. ``longest`` is the greatest length, measured if it is not given.
    """
    whole = lambda c: F.col(c).cast("bigint")
    rows = values.select(*by, whole(position).alias("j"), F.col(value).cast("double").alias("re"), F.lit(0.0).alias("im"), whole(length).alias("n"), whole(top).alias("top"))
    if longest is None:
        longest = rows.agg(F.max("n")).first()[0] or 0
    if longest <= piece:
        rows = rows.withColumns({"n1": F.col("n"), "n2": F.lit(1).cast("bigint")})
        return _transform(rows, by, long=False).drop("n")
    n1, n2 = _split_columns(F.col("n"), piece)
    lengths = rows.select("n").distinct().select("n", n1.alias("n1"), n2.alias("n2"))
    lengths = materialize(lengths.withColumn("chirp", (F.col("n") > piece) & (F.col("n1") > lopsided * F.sqrt("n"))))
    rows = rows.join(lengths, "n")
    plain = _transform(rows.where("not chirp").drop("chirp"), by, long=True).drop("n")
    if lengths.where("chirp").isEmpty():
        return plain
    return plain.unionByName(_chirp(rows.where("chirp").drop("chirp", "n1", "n2"), by, lengths.where("chirp").select("n")))


def _power_of_two(n: Column) -> dict[str, Column]:
    """Length of the convolution, at least ``2 n - 1``, and its split."""
    return {"b": F.ceil(F.log2(2 * n - 1)), "m1": F.expr("cast(pow(2, ceil(b / 2)) as bigint)"), "m": F.expr("cast(pow(2, b) as bigint)")}


def _chirp(rows: DataFrame, by: Sequence[str], lengths: DataFrame) -> DataFrame:
    """The transform of any length: ``j k = (j^2 + k^2 - (k - j)^2) / 2`` makes it a convolution with the chirp ``exp(pi i j^2 / n)``."""
    sizes = lengths
    for name, c in _power_of_two(F.col("n")).items():
        sizes = sizes.withColumn(name, c)
    sizes = sizes.withColumn("m2", F.expr("m div m1")).drop("b")
    # the square is reduced with integers first; a large one would lose digits otherwise
    angle = lambda j: F.lit(math.pi) * ((F.col(j) * F.col(j)) % (2 * F.col("length"))).cast("double") / F.col("length")
    as_input = lambda df: df.withColumnsRenamed({"n": "length"}).withColumnsRenamed({"m": "n", "m1": "n1", "m2": "n2"})
    own = as_input(rows.withColumnRenamed("top", "kept").join(sizes, "n"))
    own = own.withColumns({"im": -F.col("re") * F.sin(angle("j")), "re": F.col("re") * F.cos(angle("j")), "top": F.col("n") - 1})
    data = _transform(own.select(*by, "length", "kept", F.col("n1").alias("c1"), F.col("n2").alias("c2"), "n", "n1", "n2", "top", "j", "re", "im"),
                      [*by, "length", "kept", "c1", "c2"], long=True)
    wave = as_input(sizes).withColumn("j", F.explode(F.expr("sequence(0L, length - 1)")))
    # the chirp is even, so that each of its values but the first stands at both ends
    wave = wave.withColumn("j", F.explode(F.when(F.col("j") == 0, F.array("j")).otherwise(F.array(F.col("j"), F.col("n") - F.col("j")))))
    least = F.least(F.col("j"), F.col("n") - F.col("j"))
    wave = wave.withColumn("i", least).withColumns({"re": F.cos(angle("i")), "im": F.sin(angle("i")), "top": F.col("n") - 1})
    kernel = _transform(wave.select("length", "n", "n1", "n2", "top", "j", "re", "im"), ["length"], long=True)
    kernel = kernel.select("length", "k", F.col("re").alias("br"), F.col("im").alias("bi"))
    both = data.join(kernel, ["length", "k"])
    product = both.select(*by, "length", "kept", "n", F.col("c1").alias("n1"), F.col("c2").alias("n2"), F.col("kept").alias("top"), F.col("k").alias("j"),
                          (F.col("re") * F.col("br") - F.col("im") * F.col("bi")).alias("re"), (F.col("re") * F.col("bi") + F.col("im") * F.col("br")).alias("im"))
    back = _transform(product, [*by, "length", "kept"], long=True, forward=False)
    c, s = F.cos(angle("k")), F.sin(angle("k"))
    return back.select(*by, "k", (F.col("re") * c + F.col("im") * s).alias("re"), (F.col("im") * c - F.col("re") * s).alias("im"))
