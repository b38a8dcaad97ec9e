"""Token packing: best-fit decreasing with a segment tree over remaining capacities.

A document's token ids are cut into full windows and a rest shorter than a window. Full windows are sequences of
their own. The rests of a run of documents are placed longest first, each into the tightest open window that still
holds it; a segment tree indexed by remaining capacity finds that window in ``log2(window)`` steps.

Packing needs no shuffle: a task packs the documents of its partition in runs of at most ``run_tokens`` tokens, so
memory is one run (or one document, if that is longer) and a hot source cannot gather in one task. Each run leaves
at most a few windows partly filled, about one window in ``run_tokens / window``.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

#: Sequence ids of a partition start at its number shifted by so many bits.
SEQUENCE_BITS = 36

# The pre-tokenising pattern of the byte-level vocabulary, and the byte values that it writes as themselves
# (the others stand for the characters from U+0100 on, in order).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_BYTES = (*range(33, 127), *range(161, 173), *range(174, 256))


@dataclass(frozen=True)
class Packing:
    """``window``: tokens of a sequence; ``end_id``: id that ends every document, ``None`` for none."""

    tokenizer: str
    window: int = 1024
    end_id: int | None = 0
    run_tokens: int = 4_000_000


class Encoder:
    """Text -> token ids as little-endian ``uint32`` bytes, as the byte-level tokenizer file at ``path`` gives them.

    The merges of the file are run by the faster of two libraries; a text that it refuses (its pattern can run out of
    stack on a very long run of blanks) is encoded by the tokenizer itself. Special tokens are found in texts by both.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        self.path, self.load, self.tokenizer = path, Tokenizer.from_file, None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        byte = {chr(b): b for b in PLAIN_BYTES}
        byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PLAIN_BYTES)}
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
        self.quick = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        try:
            return self.quick.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        except ValueError:
            self.tokenizer = self.tokenizer or self.load(self.path)
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class Capacities:
    """Open windows by remaining capacity, with a segment tree of counts to find the tightest fit."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, item: int) -> None:
        self.open[capacity].append(item)
        at = self.size + capacity
        while at:
            self.tree[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (item, capacity) of the smallest capacity that is at least ``need``."""
        tree, at = self.tree, self.size + need
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        capacity = at - self.size
        while at:
            tree[at] -= 1
            at >>= 1
        return self.open[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length (all within ``window``), and the number of bins; ties keep their order."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free, used = Capacities(window), 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        if (got := free.take(n)) is None:
            got, used = (used, window), used + 1
        bins[i], offsets[i] = got[0], window - got[1]
        if got[1] > n:
            free.add(got[1] - n, got[0])
    return bins, offsets, used


def _runs(batches: Iterator[pa.RecordBatch], s: Packing, id_col: str, text_col: str):
    """Runs of (document ids, their id bytes), each run of at most ``run_tokens`` tokens unless one text is longer."""
    encode = Encoder(s.tokenizer)
    end = b"" if s.end_id is None else np.asarray([s.end_id], "<u4").tobytes()
    docs, ids, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(batch.schema.get_field_index(id_col)),
                             batch.column(batch.schema.get_field_index(text_col)), strict=True):
            raw = encode(text.as_py()) + end
            if docs and size + len(raw) > 4 * s.run_tokens:
                yield docs, ids
                docs, ids, size = [], [], 0
            docs.append(doc.as_py())
            ids.append(raw)
            size += len(raw)
    if docs:
        yield docs, ids


def _placed(ids: list[bytes], window: int, first: int) -> tuple[np.ndarray, int]:
    """Pieces of a run as rows (document index, start, length, sequence, offset), and the next free sequence."""
    total = np.asarray([len(raw) // 4 for raw in ids], np.int64)
    full, rest = total // window, total % window
    doc = np.repeat(np.arange(len(ids)), full)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
    whole = np.column_stack([doc, nth * window, np.full(len(doc), window), first + np.arange(len(doc)),
                             np.zeros(len(doc), np.int64)])
    part = np.flatnonzero(rest)
    bins, offsets, used = best_fit_decreasing(rest[part], window)
    tail = np.column_stack([part, full[part] * window, rest[part], first + len(doc) + bins, offsets])
    return np.concatenate([whole, tail]).astype(np.int64), first + len(doc) + used


def _first_sequence() -> int:
    return TaskContext.get().partitionId() << SEQUENCE_BITS


def pack(docs: DataFrame, s: Packing, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document; one row per piece.

    Columns: ``id_col``, ``start`` (ids of the document before the piece), ``length``, ``ids`` (the piece's token
    ids, little-endian ``uint32`` bytes), ``doc_tokens``, ``sequence_id``, ``offset``. Pieces fill a sequence
    from 0 without gaps; what is left up to ``window`` is padding. A null text is an empty one; a document without
    any id (an empty text and no ``end_id``) has no piece. Repeated rows are packed each by itself; further columns
    of ``docs`` are ignored.
    """
    schema = StructType([
        docs.schema[id_col], StructField("start", LongType()), StructField("length", LongType()),
        StructField("ids", BinaryType()), StructField("doc_tokens", LongType()),
        StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return _mapped(docs, s, id_col, text_col, schema, lambda raw: raw)


def pack_digests(docs: DataFrame, s: Packing, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`pack` with ``ids_crc32`` in place of ``ids``, so that the ids need not leave the packing task."""
    schema = StructType([
        docs.schema[id_col], StructField("start", LongType()), StructField("length", LongType()),
        StructField("ids_crc32", LongType()), StructField("doc_tokens", LongType()),
        StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return _mapped(docs, s, id_col, text_col, schema, zlib.crc32)


def _mapped(docs: DataFrame, s: Packing, id_col: str, text_col: str, schema: StructType, of_ids) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    wanted = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nxt = _first_sequence()
        for names, ids in _runs(batches, s, id_col, text_col):
            rows, nxt = _placed(ids, s.window, nxt)
            for low in range(0, len(rows), 16_384):
                doc, start, length, sequence, offset = rows[low:low + 16_384].T
                made = [of_ids(ids[d][4 * a:4 * (a + n)]) for d, a, n in zip(doc, start, length, strict=True)]
                cols = [[names[d] for d in doc], start, length, made, [len(ids[d]) // 4 for d in doc], sequence, offset]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(cols, wanted, strict=True)], schema=wanted)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def packed_matrix(docs: DataFrame, s: Packing, id_col: str = "doc_id", text_col: str = "text",
                  pad_id: int = 0, dtype: str = "<u2") -> DataFrame:
    """Packed sequences in the form a trainer reads; one row per sequence.

    Columns: ``sequence_id``; ``ids``, a matrix row of ``window`` ids of type ``dtype`` (little-endian, padded
    with ``pad_id``); ``n_tokens``; ``cu_seqlens``, the cumulative segment lengths from 0 to ``n_tokens``;
    ``position_ids``, a row of that type that starts again from 0 at every segment and at the padding; ``doc_ids``
    and ``starts``, for each segment its document and the ids of that document before it.
    Ids or positions that do not fit ``dtype`` raise ``OverflowError``. Nulls, empty texts and repeated rows as in :func:`pack`.
    Written with any Spark writer, this is the binary output; :func:`unpack` restores each document's ids.
    """
    schema = StructType([
        StructField("sequence_id", LongType()), StructField("ids", BinaryType()), StructField("n_tokens", IntegerType()),
        StructField("cu_seqlens", ArrayType(IntegerType(), False)), StructField("position_ids", BinaryType()),
        StructField("doc_ids", ArrayType(docs.schema[id_col].dataType)), StructField("starts", ArrayType(LongType(), False))])
    from pyspark.sql.pandas.types import to_arrow_schema
    wanted = to_arrow_schema(schema)
    top = int(np.iinfo(dtype).max)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nxt, width = _first_sequence(), s.window
        for names, ids in _runs(batches, s, id_col, text_col):
            rows, nxt = _placed(ids, width, nxt)
            rows = rows[np.lexsort((rows[:, 4], rows[:, 3]))]
            cuts = np.flatnonzero(np.diff(rows[:, 3], prepend=-1))
            made: list[tuple] = []
            for low, high in zip(cuts, [*cuts[1:], len(rows)], strict=True):
                line, places, ends = np.full(width, pad_id, np.uint32), np.zeros(width, np.uint32), [0]
                for d, start, length, _, offset in rows[low:high]:
                    line[offset:offset + length] = np.frombuffer(ids[d], "<u4", length, 4 * start)
                    places[offset:offset + length] = np.arange(length)
                    ends.append(int(offset + length))
                places[ends[-1]:] = np.arange(width - ends[-1])
                if max(line.max(initial=0), width - 1) > top:
                    raise OverflowError(f"an id or position over {top} does not fit {dtype}")
                made.append((int(rows[low, 3]), line.astype(dtype).tobytes(), ends[-1], ends, places.astype(dtype).tobytes(),
                             [names[d] for d in rows[low:high, 0]], rows[low:high, 1].tolist()))
                if len(made) == 2048:
                    yield _batch(made, wanted)
                    made = []
            if made:
                yield _batch(made, wanted)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def unpack(packed: DataFrame, dtype: str = "<u2") -> DataFrame:
    """Segments of :func:`packed_matrix` again: ``(doc_id, start, ids)`` with ``ids`` as an array of longs."""
    schema = StructType([StructField("doc_id", packed.schema["doc_ids"].dataType.elementType),
                         StructField("start", LongType()), StructField("ids", ArrayType(LongType(), False))])
    from pyspark.sql.pandas.types import to_arrow_schema
    wanted = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                line = np.frombuffer(r["ids"], dtype)
                rows += [(d, a, line[lo:hi].tolist()) for d, a, lo, hi in zip(
                    r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False)]
            if rows:
                yield _batch(rows, wanted)

    return packed.select("ids", "cu_seqlens", "doc_ids", "starts").mapInArrow(run, schema)
