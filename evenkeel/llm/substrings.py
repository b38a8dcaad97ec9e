"""Substring dedup by relative Lempel-Ziv parsing.

A word is removed if a run of ``window`` words around it also starts in a document of smaller id. A reference block is a
document, indexed by the hashes of its runs; a document is parsed against a block greedily: at the first
run that the block holds the factor is made as long as it goes, verified word by word, and parsing goes on with
the runs that cross the factor's boundary. Factors of ``window`` words or more are duplicate spans.

Which blocks a document can share a run with is told by anchors: of the ``seed``-word hashes in each run the
smallest one is the run's anchor, so equal runs have equal anchors and a document has one anchor for some ten words. Each
shared anchor sends the document to the block of the smallest id that has it. A run with that anchor that this block does
not hold is compared, by a 128-bit hash, with the open runs of all other documents: any document that has the run has its
anchor, thus the same block, and there the run is open as well. So every run is decided, and the work is linear.

Blocks with many readers are copied to several tasks; a task holds one block and one document at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from evenkeel.llm.common import WordHashes, append_columns, mix64, utf8
from evenkeel.session import broadcast_rows_limit, discard, materialize, shuffle_parts

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64


@dataclass(frozen=True)
class Settings:
    """``readers``: documents that one copy of a reference block serves."""

    window: int = 50
    seed: int = 16
    readers: int = 500


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, from differences of a running polynomial sum modulo 2^64."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(words) - 1, BASE, np.uint64)]), dtype=np.uint64)
    back = np.uint64(pow(BASE, -1, 1 << 64))
    inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(count - 1, back, np.uint64)]), dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power, dtype=np.uint64)])
    return mix64((total[n:] - total[:-n]) * inverse)


def smallest(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every ``n`` consecutive values."""
    width = 1
    while 2 * width <= n:
        values, width = np.minimum(values[:-width], values[width:]), 2 * width
    return np.minimum(values[:len(values) - (n - width)], values[n - width:]) if n > width else values


class Words:
    """Words of a text, with hashes and places in the text that joins them with one blank."""

    def __init__(self, text: str | None, hashes: WordHashes):
        self.words = utf8(text).split()
        self.hash = hashes.array(self.words)
        self.joined = b" ".join(self.words)
        lengths = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.stops = np.cumsum(lengths + 1) - 1
        self.starts = self.stops - lengths

    def between(self, start: int, stop: int) -> bytes:
        return self.joined[self.starts[start]:self.stops[stop - 1]]

    def anchors(self, s: Settings) -> np.ndarray:
        """The anchor of every run."""
        if len(self.words) < s.window:
            return np.empty(0, np.uint64)
        return smallest(run_hashes(self.hash, s.seed), s.window - s.seed + 1)


class Block:
    """A reference block: the runs of a text in the order of their hashes."""

    def __init__(self, text: str | None, hashes: WordHashes, s: Settings):
        self.text, self.s = Words(text, hashes), s
        runs = run_hashes(self.text.hash, s.window)
        self.order = np.argsort(runs, kind="stable")
        self.runs = runs[self.order]

    def factors(self, doc: Words, runs: np.ndarray) -> list[tuple[int, int]]:
        """Factors (start, stop) of at least a window that the block holds, in order; every run it holds is in one."""
        out: list[tuple[int, int]] = []
        if not len(self.runs):
            return out
        at = np.searchsorted(self.runs, runs)
        found = np.flatnonzero(self.runs[np.minimum(at, len(self.runs) - 1)] == runs)
        nth = 0
        while nth < len(found):
            start = int(found[nth])
            stop = self._longest(doc, start, int(at[start]), int(runs[start]))
            if stop:
                out.append((start, stop))
                nth = int(np.searchsorted(found, stop - self.s.window + 1))
            else:
                nth += 1
        return out

    def _longest(self, doc: Words, start: int, at: int, run: int) -> int:
        """End of the factor that starts at ``start``: the first place of the run that holds, as far as it goes; else 0."""
        ours, theirs, n = doc.hash, self.text.hash, self.s.window
        while at < len(self.runs) and int(self.runs[at]) == run:
            place = int(self.order[at])
            length, most = n, min(len(ours) - start, len(theirs) - place)
            step = 64
            while length < most:
                upto = min(most, length + step)
                differ = np.flatnonzero(ours[start + length:start + upto] != theirs[place + length:place + upto])
                if len(differ):
                    length += int(differ[0])
                    break
                length, step = upto, 2 * step
            if doc.between(start, start + length) == self.text.between(place, place + length):
                return start + length
            if doc.between(start, start + n) == self.text.between(place, place + n):
                return start + n
            at += 1
        return 0


def _anchors(docs: DataFrame, s: Settings) -> DataFrame:
    """(anchor, id), each once for a row of ``docs(id, text)``."""
    schema = pa.schema([("anchor", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, found, size = [], [], 0
            for name, text in zip(batch.column(0).to_numpy(), batch.column(1), strict=True):
                own = np.unique(Words(text.as_py(), hashes).anchors(s))
                found.append(own)
                ids.append(np.full(len(own), name))
                size += len(own)
                if size > 200_000:
                    yield _pairs(found, ids, schema)
                    ids, found, size = [], [], 0
            if size:
                yield _pairs(found, ids, schema)

    return docs.select("id", "text").mapInArrow(run, "anchor bigint, id bigint")


def _pairs(found: list[np.ndarray], ids: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(ids).astype(np.int64))], schema=schema)


PARSED = "id bigint, copy bigint, start bigint, stop bigint, high bigint, low bigint"


def _parse(rows: DataFrame, s: Settings) -> DataFrame:
    """Spans and open runs of documents sorted behind their reference blocks.

    ``rows``: (block, salt, kind, id, copy, text, anchors), kind 0 for a block and 1 for a reader. A span has ``stop``; an
    open run has its hash in ``high`` and ``low``.
    """
    schema = pa.schema([(c.split()[0], pa.int64()) for c in PARSED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, now, blocks = WordHashes(), None, []
        for batch in batches:
            out: list[np.ndarray] = []
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("block", "salt", "kind", "id", "copy", "text", "anchors")]
            for r in zip(*cols, strict=True):
                block, salt, kind = (x.as_py() for x in r[:3])
                if now != (block, salt):
                    now, blocks = (block, salt), []
                if kind == 0:
                    blocks.append(Block(r[5].as_py(), hashes, s))
                    continue
                doc, name, copy = Words(r[5].as_py(), hashes), r[3].as_py(), r[4].as_py()
                runs = run_hashes(doc.hash, s.window)
                held = np.zeros(len(runs), bool)
                for b in blocks:
                    for start, stop in b.factors(doc, runs):
                        held[start:stop - s.window + 1] = True
                        out.append(np.asarray([[name, copy, start, stop, 0, 0]], np.int64))
                wanted = np.asarray(r[6].values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
                open_ = np.flatnonzero(np.isin(doc.anchors(s), wanted) & ~held)
                if len(open_):
                    keys = np.asarray([divmod(xxhash.xxh3_128_intdigest(doc.between(i, i + s.window)), 1 << 64) for i in open_.tolist()],
                                      np.uint64).view(np.int64)
                    fixed = np.asarray([name, copy], np.int64)
                    out.append(np.column_stack([np.tile(fixed, (len(open_), 1)), open_, np.full(len(open_), -1), keys]))
            if out:
                table = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in table.T], schema=schema)

    return rows.mapInArrow(run, PARSED)


def spans(docs: DataFrame, s: Settings) -> DataFrame:
    """``(id, copy, start, stop)``: words of ``docs(id, copy, text)`` covered by runs of documents of smaller id."""
    spark, parts = docs.sparkSession, shuffle_parts(docs.sparkSession)
    anchors = materialize(_anchors(docs, s))
    shared = anchors.groupBy("anchor").agg(F.min("id").alias("block"), F.max("id").alias("last")).where("block < last")
    readers = materialize(anchors.join(shared, "anchor").where("id > block").groupBy("block", "id")
                          .agg(F.collect_set("anchor").alias("anchors")))
    copies = materialize(readers.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / s.readers).cast("bigint").alias("copies")))
    wanted = materialize(readers.select("id").union(copies.select("block")).distinct())
    if wanted.count() <= broadcast_rows_limit(spark):  # eight bytes a row; beyond it the joins below shuffle all documents
        docs = docs.join(F.broadcast(wanted), "id")
    read = (readers.join(copies, "block").join(docs, "id")
            .select("block", F.pmod(F.xxhash64("id", "copy"), "copies").alias("salt"), F.lit(1).alias("kind"), "id", "copy", "text", "anchors"))
    held = (copies.join(docs.withColumnRenamed("id", "block"), "block")
            .select("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("kind"),
                    F.lit(None).cast("bigint").alias("id"), "copy", "text", F.array().cast("array<bigint>").alias("anchors")))
    parsed = materialize(_parse(read.unionByName(held).repartition(parts, "block", "salt").sortWithinPartitions("block", "salt", "kind"), s))
    open_ = parsed.where("stop < 0")
    first = open_.groupBy("high", "low").agg(F.min("id").alias("least"), F.max("id").alias("last")).where("least < last")
    late = open_.join(first, ["high", "low"]).where("id > least").select("id", "copy", "start", (F.col("start") + s.window).alias("stop"))
    out = materialize(parsed.where("stop >= 0").select("id", "copy", "start", "stop").unionByName(late))
    discard(anchors, readers, copies, wanted, parsed)
    return out


def dedup(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``n_words``, ``n_removed`` and ``kept_text`` (the words left, joined by one blank) to every row of ``docs``.

    Words are runs of characters other than ASCII white space, unchanged; runs are judged on the input. Null
    texts have no words and an empty ``kept_text``. Rows of equal id are never each other's source; repeated rows (same id and
    text) lose the same words. Rows without id neither lose words nor are sources. Other columns stay; one that
    has the name of an output is replaced.
    """
    fields = StructType([StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())])
    copy = F.xxhash64(text_col)
    own = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), copy.alias("copy"), F.col(text_col).alias("text"))
    found = spans(own, s).groupBy(F.col("id").alias("_id"), F.col("copy").alias("_copy")).agg(
        F.collect_set(F.struct("start", "stop")).alias("_spans"))
    rows = docs.withColumns({"_mine": F.col(id_col).cast("bigint"), "_own": copy})
    rows = rows.join(found, (F.col("_mine") == F.col("_id")) & (F.col("_own") == F.col("_copy")), "left").select(*docs.columns, "_spans")

    def make():
        def work(texts: list, gone: list) -> list:
            n_words, n_removed, kept = [], [], []
            for text, marks in zip(texts, gone, strict=True):
                words = utf8(text).split()
                n_words.append(len(words))
                if marks:
                    stay = np.ones(len(words), bool)
                    for m in marks:
                        stay[m["start"]:m["stop"]] = False
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            return [n_words, n_removed, kept]
        return work

    return append_columns(rows, [text_col, "_spans"], fields, make).drop("_spans")
