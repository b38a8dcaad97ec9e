"""Phrase mining with counting quotient filters.

A phrase of two to five words is the sequence of its word ids, packed into 125 bits; only words that are frequent enough
themselves have ids. An invertible permutation scatters the packed phrase over 128 bits: the leading bits are the quotient, all the
others are kept as remainder, so a filter is a lossless table of counters. It is held in the order of (quotient, remainder):
run lengths for the quotients, remainders without the quotient's bytes, counts in the narrowest width that holds them. Each
task counts into a filter of its own; the filters are cut by the first bits into shards, and the sorted filters of a shard are merged.

Phrases are counted in two passes over the written id sequences: pairs first, then phrases of three to five words all of whose
pairs are frequent. The second pass knows frequent pairs by a bitmap over quotients of at most ``2 ** bitmap_bits`` bits: a pair
that is not frequent may pass and is then counted in vain, no frequent one is missed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import mix64, utf8
from evenkeel.operators.ordered import number_rows
from evenkeel.session import broadcast_rows_limit, discard, materialize, shuffle_parts

LONGEST = 5
FIELD = 25  # bits of a word id
U = np.uint64

#: ASCII letters to lower case, tabs to blanks, ends of pieces to line feeds.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
END = b"\n"


@dataclass(frozen=True)
class Settings:
    """``buffer``: occurrences that a task sorts at once; ``entries``: counters of a filter before it is handed on."""

    least: int = 100
    top: int = 2_000
    buffer: int = 1 << 20
    entries: int = 1 << 21
    words_kept: int = 500_000
    bitmap_bits: int = 29


def tokens(text: str | None) -> list[bytes]:
    """Words of a text in order, with ``END`` where a piece ends."""
    return list(filter(None, utf8(text).translate(PLAIN).replace(END, b" \n ").split(b" ")))


# --- the filter ---------------------------------------------------------------------------------

def pack(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases, one array of ids for each place, as 125 bits from the left; ids start at 1, so lengths stay apart."""
    f = [a.astype(U) for a in ids] + [U(0)] * (LONGEST - len(ids))
    high = (f[0] << U(39)) | (f[1] << U(14)) | (f[2] >> U(11))
    low = ((f[2] & U(0x7FF)) << U(53)) | (f[3] << U(28)) | (f[4] << U(3))
    return high, np.broadcast_to(low, high.shape)


def unpack(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    mask = U((1 << FIELD) - 1)
    fields = [high >> U(39), high >> U(14), (high << U(11)) | (low >> U(53)), low >> U(28), low >> U(3)]
    return np.column_stack([f & mask for f in fields]).astype(np.int32)


def scatter(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An invertible permutation: two Feistel rounds over 128 bits; values without low part, as pairs, stay within 64 bits."""
    short = low == 0
    mixed = low ^ mix64(high + U(0x9E3779B97F4A7C15))
    mixed = np.where(mixed == 0, low, mixed)  # a low part stays one: the single value that would be zero is left as it is
    return np.where(short, mix64(high), high ^ mix64(mixed)), np.where(short, U(0), mixed)


def gather(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    short = low == 0
    own = high ^ mix64(low)
    key = mix64(own + U(0x9E3779B97F4A7C15))
    return np.where(short, unmix64(high), own), np.where(short | (low == key), low, low ^ key)


def unmix64(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix64``."""
    undo = lambda y, s: y ^ (y >> U(s)) ^ (y >> U(2 * s))  # three shifts are past 64 bits
    x = undo(x, 31) * U(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = undo(x, 27) * U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return undo(x, 30)


@dataclass
class Filter:
    """Counters in the order of their scattered keys."""

    high: np.ndarray
    low: np.ndarray
    counts: np.ndarray

    @staticmethod
    def merged(parts: list[Filter]) -> Filter:
        """One filter with the counts of all."""
        high, low, counts = (np.concatenate([getattr(p, c) for p in parts]) for c in ("high", "low", "counts"))
        order = np.argsort(high, kind="stable")
        high, low = high[order], low[order]
        if len(high) > 1 and ((high[1:] == high[:-1]) & (low[1:] != low[:-1])).any():
            again = np.lexsort((low, high))
            high, low, order = high[again], low[again], order[again]
        first = np.ones(len(high), bool)
        first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        starts = np.flatnonzero(first)
        totals = np.add.reduceat(counts[order], starts) if len(starts) else counts
        return Filter(high[starts], low[starts], totals)

    @staticmethod
    def of(high: np.ndarray, low: np.ndarray) -> Filter:
        return Filter.merged([Filter(*scatter(high, low), np.ones(len(high), np.int64))])

    def shard(self, start: int, stop: int) -> Filter:
        return Filter(self.high[start:stop], self.low[start:stop], self.counts[start:stop])

    def dump(self) -> bytes:
        """Number of counters, bytes of the quotient, of a key and of a count; run lengths, remainders, counts."""
        n = len(self.high)
        wide = 0 if n < 256 else 1 if n < 65_536 else 2
        quotient = (self.high >> U(64 - 8 * wide)).astype(np.int64) if wide else np.zeros(n, np.int64)
        runs = np.bincount(quotient, minlength=256**wide).astype("<u4")
        size = 16 if self.low.any() else 8
        keys = np.column_stack([self.high, self.low]).astype(">u8").view(np.uint8).reshape(n, 16)[:, wide:size]
        kind = next(k for k in (1, 2, 4, 8) if k == 8 or int(self.counts.max(initial=0)) < 256**k)
        head = np.asarray([n, wide, size, kind], "<u8").tobytes()
        return head + runs.tobytes() + np.ascontiguousarray(keys).tobytes() + self.counts.astype(f"<u{kind}").tobytes()

    @staticmethod
    def load(data: bytes) -> Filter:
        n, wide, size, kind = (int(x) for x in np.frombuffer(data, "<u8", 4))
        at = 32
        runs = np.frombuffer(data, "<u4", 256**wide, at)
        at += runs.nbytes
        keys = np.zeros((n, 16), np.uint8)
        keys[:, wide:size] = np.frombuffer(data, np.uint8, n * (size - wide), at).reshape(n, size - wide)
        at += n * (size - wide)
        both = keys.view(">u8").astype(U)
        if wide:
            both[:, 0] |= np.repeat(np.arange(256**wide, dtype=U), runs) << U(64 - 8 * wide)
        return Filter(both[:, 0], both[:, 1], np.frombuffer(data, f"<u{kind}", n, at).astype(np.int64))


# --- words ---------------------------------------------------------------------------------------

def word_counts(docs: DataFrame, s: Settings) -> DataFrame:
    """``(lang, word, f)`` of ``docs(lang, text)``, counted within tasks first."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush():
            for lang, counts in held.items():
                counts.pop(END, None)
                words = list(counts)
                for at in range(0, len(words), 50_000):
                    some = words[at:at + 50_000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([counts[w] for w in some], pa.int64())], schema=schema)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                held.setdefault(lang, Counter()).update(tokens(text.as_py()))
                if len(held[lang]) > s.words_kept:
                    yield from flush()
            if sum(map(len, held.values())) > s.words_kept:
                yield from flush()
        yield from flush()

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def id_sequences(docs: DataFrame, words: DataFrame) -> DataFrame:
    """``ids``: the word ids of each row of ``docs(lang, text)``; 0 stands between what is not contiguous.

    A vocabulary of at most ``evenkeel.broadcast.rows`` words is sent to all tasks; a larger one is joined by shuffle.
    """
    spark = docs.sparkSession
    schema = pa.schema([("ids", pa.list_(pa.int32()))])
    if words.count() <= broadcast_rows_limit(spark):
        known: dict[str, dict[bytes, int]] = {}
        for r in words.select("lang", "word", "id").collect():
            known.setdefault(r["lang"], {})[r["word"].encode()] = r["id"]
        shared = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                    own, found = shared.value.get(lang, {}), tokens(text.as_py())
                    ids = np.fromiter((own.get(w, 0) for w in found), np.int32, len(found))
                    keep = np.ones(len(ids), bool)
                    keep[1:] = (ids[1:] != 0) | (ids[:-1] != 0)
                    out.append(ids[keep])
                sizes = np.concatenate([[0], np.cumsum([len(o) for o in out])]).astype(np.int32)
                flat = np.concatenate(out) if out else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], schema=schema)

        return materialize(docs.select("lang", "text").mapInArrow(run, "ids array<int>"))

    spread = pa.schema([("lang", pa.string()), ("row", pa.int64()), ("at", pa.int64()), ("word", pa.string())])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, row, text in zip(batch.column("lang").to_pylist(), batch.column("row").to_pylist(), batch.column("text"), strict=True):
                found = tokens(text.as_py())
                for at in range(0, len(found), 50_000):
                    some = found[at:at + 50_000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(some)), pa.array([row] * len(some), pa.int64()), pa.array(np.arange(at, at + len(some))),
                        pa.array(some, pa.binary()).cast(pa.string())], schema=spread)

    numbered = docs.select("lang", "text").withColumn("row", F.monotonically_increasing_id())
    places = materialize(numbered.mapInArrow(explode, "lang string, row bigint, at bigint, word string"))
    ids = places.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("at", "id"))).alias("found"))

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in batch.column("found"):
                at, own = (found.values.field(i).to_numpy() for i in (0, 1))
                place = np.arange(len(own)) + np.cumsum(np.diff(at, prepend=at[:1]) > 1)
                out = np.zeros(int(place[-1]) + 1, np.int32)
                out[place] = own
                yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.int32()))], schema=schema)

    done = materialize(ids.select("found").mapInArrow(gaps, "ids array<int>"))
    discard(places)
    return done


# --- phrases -------------------------------------------------------------------------------------

def _occurrences(ids: np.ndarray, stop: int, pairs: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Packed pairs that start before ``stop``; with the bitmap ``pairs`` the packed phrases of three to five words."""
    there = ids > 0
    both = np.flatnonzero(there[:-1] & there[1:])
    if pairs is None:
        both = both[both < stop]
        return pack([ids[both], ids[both + 1]])
    bits = len(pairs).bit_length() + 2
    spot = scatter(*pack([ids[both], ids[both + 1]]))[0] >> U(64 - bits)
    known = np.zeros(len(ids), bool)
    known[both] = (pairs[(spot >> U(3)).astype(np.int64)] >> (spot & U(7)).astype(np.uint8)) & 1 == 1
    highs, lows, run = [], [], known
    for n in range(3, LONGEST + 1):
        run = run[:-1] & known[n - 2:]
        at = np.flatnonzero(run[:stop])
        high, low = pack([ids[at + i] for i in range(n)])
        highs.append(high)
        lows.append(low)
    return np.concatenate(highs), np.concatenate(lows)


def _filters(sequences: DataFrame, shards: int, pairs, s: Settings) -> DataFrame:
    """``(shard, filter)``: what each task has counted, cut at the first bits of the keys."""
    schema = pa.schema([("shard", pa.int32()), ("filter", pa.binary())])
    edges = np.arange(1, shards, dtype=U) << U(64 - (shards.bit_length() - 1)) if shards > 1 else np.empty(0, U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if pairs is None else np.frombuffer(pairs.value, np.uint8)
        waiting, size, whole = [], 0, []

        def count():
            nonlocal waiting, size, whole
            if size:
                new = Filter.of(*(np.concatenate(c) for c in zip(*waiting, strict=True)))
                whole, waiting, size = [Filter.merged([*whole, new])], [], 0

        def hand_on():
            nonlocal whole
            for f in whole:
                cuts = [0, *np.searchsorted(f.high, edges).tolist(), len(f.high)]
                for shard, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if a < b:
                        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f.shard(a, b).dump()], pa.binary())], schema=schema)
            whole = []

        for batch in batches:
            column = batch.column("ids")
            flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy()[1:] - column.offsets.to_numpy()[0]
            parted = np.insert(flat, ends, 0)  # nothing is contiguous across rows
            for at in range(0, len(parted), s.buffer):
                waiting.append(_occurrences(parted[at:at + s.buffer + LONGEST - 1], s.buffer, bitmap))
                size += len(waiting[-1][0])
                if size >= s.buffer:
                    count()
                    if whole and len(whole[0].high) >= s.entries:
                        yield from hand_on()
        count()
        yield from hand_on()

    return sequences.mapInArrow(run, "shard int, filter binary")


def _merge(filters: DataFrame, s: Settings) -> DataFrame:
    """``(ids, f)`` of the phrases that occur ``least`` times: the filters of each shard, merged."""
    schema = pa.schema([("ids", pa.list_(pa.int32())), ("f", pa.int64())])
    parts = shuffle_parts(filters.sparkSession)

    def frequent(whole: list[Filter]) -> Iterator[pa.RecordBatch]:
        f = Filter.merged(whole)
        good = f.counts >= s.least
        ids, counts = unpack(*gather(f.high[good], f.low[good])), f.counts[good]
        for at in range(0, len(ids), 10_000):
            rows = [r[:n].tolist() for r, n in zip(ids[at:at + 10_000], (ids[at:at + 10_000] > 0).sum(axis=1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), pa.array(counts[at:at + 10_000])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole, new = None, [], 0
        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("filter"), strict=True):
                if shard != now:
                    if whole:
                        yield from frequent(whole)
                    now, whole, new = shard, [], 0
                whole.append(Filter.load(data.as_py()))
                new += len(whole[-1].high)
                if new > max(s.entries, len(whole[0].high)):
                    whole, new = [Filter.merged(whole)], 0
        if whole:
            yield from frequent(whole)

    return filters.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(run, "ids array<int>, f bigint")


def _bitmap(pairs: DataFrame, s: Settings) -> bytes:
    """Bits at the quotients of the frequent pairs; about 16 bits a pair, ``2 ** bitmap_bits`` at most."""
    bits = min(s.bitmap_bits, max(10, (16 * pairs.count()).bit_length()))
    piece = min(bits, 16)
    schema = pa.schema([("piece", pa.int32()), ("spot", pa.int32())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("ids").to_pylist(), np.int64).reshape(-1, 2)
            spot = scatter(*pack([ids[:, 0], ids[:, 1]]))[0] >> U(64 - bits)
            yield pa.RecordBatch.from_arrays([pa.array((spot >> U(piece)).astype(np.int32)), pa.array((spot & U((1 << piece) - 1)).astype(np.int32))], schema=schema)

    spots = pairs.select("ids").mapInArrow(place, "piece int, spot int").groupBy("piece").agg(F.collect_set("spot").alias("spots"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in spots.toLocalIterator():  # at most 2 ** (bits - 16) rows of 2 ** 16 places each
        own = np.zeros(1 << piece, np.uint8)
        own[np.asarray(r["spots"], np.int64)] = 1
        out[r["piece"] << (piece - 3):(r["piece"] + 1) << (piece - 3)] = np.packbits(own, bitorder="little")
    return out.tobytes()


def frequent_phrases(sequences: DataFrame, s: Settings) -> DataFrame:
    """``(ids, f)`` of all phrases of two to five words that occur at least ``least`` times."""
    spark = sequences.sparkSession
    shards = 1 << (shuffle_parts(spark) - 1).bit_length()
    pairs = materialize(_merge(_filters(sequences, shards, None, s), s))
    bitmap = spark.sparkContext.broadcast(_bitmap(pairs, s))
    longer = materialize(_merge(_filters(sequences, shards, bitmap, s), s))
    return pairs.unionByName(longer)


def collocations(docs: DataFrame, s: Settings = Settings(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best ``top`` phrases of each language: ``(lang, rank, phrase, a, l, r, n, score)``.

    Texts are taken in ASCII lower case and cut into pieces at ``[.,;:!?]`` and line ends, pieces into words at blanks and
    tabs; a phrase lies within a piece. ``n`` counts the words of a language, ``a`` the phrase, ``l`` and ``r`` the two
    parts of its worst cut, ``score = floor(1000 * a * n / (l * r))``. Phrases that lie in a longer one of at least the same
    count are dropped; a phrase counts no more often than its parts, so it suffices to look one word further.

    A null text is empty, a null language is ``und`` (and counted with rows that say so). Repeated rows count each. Other
    columns are ignored. Exact as long as ``1000 * a * n`` has at most 38 digits; more than 2^25 frequent words raise ``ValueError``.
    """
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counted = materialize(word_counts(own, s))
    totals = materialize(counted.groupBy("lang").agg(F.sum("f").alias("n")))
    words = materialize(number_rows(counted.where(F.col("f") >= s.least), [], [F.col("lang"), F.col("word")], "id"))
    if (words.agg(F.max("id")).first()[0] or 0) >= 1 << FIELD:
        raise ValueError("more than 2^25 frequent words")
    words = words.withColumn("id", F.col("id").cast("int"))
    sequences = id_sequences(own, words)
    found = materialize(frequent_phrases(sequences, s))
    discard(counted, sequences)

    size = F.size("ids")
    every = found.unionByName(words.select(F.array("id").alias("ids"), "f"))
    inside = found.where(size > 2).select(F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"), "f")
    inside = inside.groupBy("ids").agg(F.max("f").alias("longer"))
    kept = found.withColumnRenamed("f", "a").join(inside, "ids", "left").where("longer is null or longer < a").drop("longer")
    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("ids", F.lit(1), F.col("k")), "right": F.slice("ids", F.col("k") + 1, size - F.col("k"))})
    cuts = cuts.join(every.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(
        every.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
    langs = words.select("id", "lang", "word")
    small = totals.count() <= broadcast_rows_limit(spark)
    cuts = cuts.withColumn("id", F.get("ids", F.lit(0))).join(langs.drop("word"), "id").join(F.broadcast(totals) if small else totals, "lang")
    long = lambda c: f"cast({c} as decimal(19, 0))"
    cuts = cuts.withColumn("score", F.expr(f"(cast(1000 as decimal(4, 0)) * {long('a')} * {long('n')}) div ({long('l')} * {long('r')})"))
    worst = cuts.groupBy("ids", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    spelt = worst.select("ids", F.posexplode("ids").alias("at", "id")).join(langs.select("id", "word"), "id").groupBy("ids").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = worst.join(spelt, "ids").select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
