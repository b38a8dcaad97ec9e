"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has bit b set where over half of the text's shingle hashes have it. Its 64 bits are cut into segments of
22, 21 and 21 bits, each padded to a word of the perfect binary Golay code (23 bits, 12 of them information, distance
7). A word gets the indices of all codewords at distance 4 or less: one or six. Two words that differ in at most 2 bits
share an index, since a word between them is at most 3 bits from some codeword. Of 4 differing bits at most one
segment has more than 2, so two fingerprints that link share an index in two segments: the join key is a
pair of segments with an index of each. Candidates of a key are verified bit by bit.

Equal fingerprints are one node from the start. Keys of many nodes are split into cells of bounded size that go to
different tasks, and a task passes on only a spanning forest of the links it finds, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from evenkeel.llm.common import append_columns, utf8
from evenkeel.operators.components import components
from evenkeel.session import discard, materialize, shuffle_parts

SHINGLE = 4
SEED = 42
MAX_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Nodes of a key that one cell holds; a key with more is split into pairs of such blocks.
CELL = 2_048

# Fixed value: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles (A-Z lower-cased, repeats included); 0 for a text without words."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = min(shingle, len(words))
    starts, stops = (ends - lengths)[:len(words) - n + 1].tolist(), ends[n - 1:].tolist()
    digest, bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for low in range(0, len(starts), 65_536):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[low:low + 65_536], stops[low:low + 65_536], strict=True)]
        raw = np.asarray(part, "<u8").view(np.uint8)
        bits += np.unpackbits(raw, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add ``out``, the fingerprint as a signed long; all rows and columns stay, a column named ``out`` is replaced."""
    def make():
        return lambda texts: [np.asarray([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    return append_columns(docs, [text_col], StructType([StructField(out, LongType())]), make)


def golay_patterns() -> np.ndarray:
    """For each syndrome (11 bits) the error patterns of weight 4 or less that have it; missing ones repeat the first."""
    by_syndrome: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            pattern = sum(1 << p for p in places)
            by_syndrome[int(syndromes(np.asarray([pattern]))[0])].append(pattern)
    width = max(map(len, by_syndrome))
    return np.asarray([p + p[:1] * (width - len(p)) for p in by_syndrome], np.int64)


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words divided by the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = rest ^ np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


class Keys:
    """Fingerprints -> join keys."""

    def __init__(self):
        self.patterns = golay_patterns()

    def indices(self, words: np.ndarray) -> np.ndarray:
        """For each 23-bit word the indices (upper 12 bits) of the codewords within distance 4, repeats filling a row."""
        return (words[:, None] ^ self.patterns[syndromes(words)]) >> 11

    def __call__(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and keys, each (row, key) once."""
        parts = [self.indices((prints >> np.uint64(at)).astype(np.int64) & (1 << n) - 1) for at, n in SEGMENTS]
        rows, keys = [], []
        for pair, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
            both = (pair << 24 | parts[i][:, :, None] << 12 | parts[j][:, None, :]).reshape(len(prints), -1)
            both.sort(axis=1)
            first = np.column_stack([np.ones(len(both), bool), both[:, 1:] != both[:, :-1]])
            rows.append(np.nonzero(first)[0])
            keys.append(both[first])
        return np.concatenate(rows), np.concatenate(keys)


def _explode(nodes: DataFrame) -> DataFrame:
    """(key, node): the keys of each fingerprint."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys()
        for batch in batches:
            prints = batch.column(0).to_numpy()
            for low in range(0, len(prints), 2_048):
                part = prints[low:low + 2_048]
                rows, key = keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[rows])], schema=schema)

    return nodes.mapInArrow(run, "key bigint, node bigint")


class Forest:
    """Union-find over nodes, that tells which links join two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (to := up.get(root, root)) != root:
            root = to
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _links(cell: np.ndarray, nodes: np.ndarray, forest: Forest) -> list[tuple[int, int]]:
    """Links between nodes of equal ``cell`` (sorted) that the forest does not imply yet."""
    bits, out = nodes.view(np.uint64), []
    at, gap = np.arange(len(cell)), 1
    while len(at := at[at < len(cell) - gap]) and len(at := at[cell[at] == cell[at + gap]]):
        near = at[np.bitwise_count(bits[at] ^ bits[at + gap]) <= MAX_BITS]
        near = near[nodes[near] != nodes[near + gap]]
        out += [(a, b) for a, b in zip(nodes[near].tolist(), nodes[near + gap].tolist(), strict=True) if forest.join(a, b)]
        gap += 1
    return out


def _forests(cells: DataFrame) -> DataFrame:
    """(left, right): for each partition, sorted by cell, a spanning forest of its links."""
    schema = pa.schema([("left", pa.int64()), ("right", pa.int64())])

    def solve(cell: np.ndarray, nodes: np.ndarray, forest: Forest) -> Iterator[pa.RecordBatch]:
        if found := _links(cell, nodes, forest):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, cell, nodes = Forest(), np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            cell = np.append(cell, batch.column(0).to_numpy())
            nodes = np.append(nodes, batch.column(1).to_numpy())
            if len(cell) >= 100_000:  # the last cell may go on in the next batch
                done = int(np.searchsorted(cell, cell[-1]))
                yield from solve(cell[:done], nodes[:done], forest)
                cell, nodes = cell[done:], nodes[done:]
        yield from solve(cell, nodes, forest)

    return cells.mapInArrow(run, "left bigint, right bigint")


def links(nodes: DataFrame, cell_rows: int = CELL) -> DataFrame:
    """Links ``(left, right)`` that connect the distinct fingerprints ``nodes(node)`` as all links would.

    A key with more than ``cell_rows`` nodes is cut into blocks; each pair of blocks is a cell of its own, so that
    every pair of the key still meets and no cell has more than about twice that many rows.
    """
    keyed = _explode(nodes)
    hot = (keyed.groupBy("key").count().where(F.col("count") > cell_rows)
           .select("key", F.ceil(F.col("count") / cell_rows).cast("bigint").alias("blocks")))
    block = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1)))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("blocks", F.lit(1)) - 1))
    cells = (keyed.join(hot, "key", "left").select("key", "node", block.alias("b"), other.alias("o"))
             .select(F.xxhash64("key", F.least("b", "o"), F.greatest("b", "o")).alias("cell"), "node"))
    parts = shuffle_parts(nodes.sparkSession)
    return _forests(cells.repartition(parts, "cell").sortWithinPartitions("cell"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest id that can be reached over links of
    at most 4 differing bits, the row's own included. Texts that are null or have no words have fingerprint zero and link
    as any other. Repeated rows stay; null ids stay and are no smallest id unless a class has none else. Other
    columns are ignored.
    """
    prints = materialize(fingerprints(docs.select(id_col, text_col)).select(F.col(id_col).alias("id"), "fingerprint"))
    nodes = materialize(prints.groupBy(F.col("fingerprint").alias("node")).agg(F.min("id").alias("least")))
    edges = links(nodes.select("node").repartition(shuffle_parts(docs.sparkSession)))
    named = components(nodes.select("node"), edges).join(nodes, "node")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = materialize(named.join(least, "component").select(F.col("node").alias("fingerprint"), "component_id"))
    discard(nodes)
    return prints.join(by_print, "fingerprint").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: that of the smallest id. Rows without id are not judged and stay.

    Of rows that repeat an id the one of the smallest text stays, then of the smallest row as JSON, whatever the partitions are.
    """
    named = docs.where(F.col(id_col).isNotNull())
    kept = classes(named, id_col, text_col).where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    whole = F.struct(*docs.columns)
    first = F.min_by(whole, F.struct(F.col(text_col), F.to_json(whole)))
    one = named.join(kept, id_col, "left_semi").groupBy(id_col).agg(first.alias("_first")).select("_first.*")
    return one.unionByName(docs.where(F.col(id_col).isNull()))
