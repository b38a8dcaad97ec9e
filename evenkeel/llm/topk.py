"""Exact top-k inner-product search: best-first search in M-trees.

Vectors become whole numbers ``floor(256 * x)``. With one more coordinate ``sqrt(M^2 - |x|^2)`` (``M`` the longest
vector of a tree) all vectors of a tree are equally long, so the nearest ones to a query are those of the highest
inner product and distances obey the triangle inequality. A tree is built of pages: each entry of an inner page has a
pivot, the covering radius of what lies below it, and the distance to the pivot of its own page; a leaf page
has the vectors with that distance. The search takes the page with the best bound first. An entry whose stored distance
already rules it out, by the triangle inequality, is passed over without computing its distance to the query.

A tree holds at most ``tree_rows`` vectors of one partition, so nothing is shuffled to build it. The stated query set is
read in blocks; a block meets every tree where it lies, and each tree returns at most k rows for a query, only those
that beat what the block's own vectors already reach. Bounds carry a margin for rounding; scores are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.session import materialize

MARGIN = 1e-9
#: How often the pivots of a page are moved to the middle of their part.
ROUNDS = 2


@dataclass(frozen=True)
class Settings:
    k: int = 5
    page: int = 64
    fan_out: int = 32
    tree_rows: int = 16_384
    query_rows: int = 2_048


def whole_numbers(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of the vector: ids and rows ``floor(256 * x)`` of the vectors that take part."""
    there = pc.and_(pc.is_valid(ids), pc.is_valid(vectors))
    ids, vectors = ids.filter(there), vectors.filter(there)
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(lengths):
        at = pa.array(np.flatnonzero(lengths == n))
        own = ids.take(at).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(vectors.take(at)).cast(pa.float64()).to_numpy(zero_copy_only=False)
        rows = np.floor(256.0 * flat).reshape(len(own), int(n))
        fine = np.isfinite(rows).all(axis=1)
        if fine.any():
            out[int(n)] = own[fine], rows[fine]
    return out


def exact_products(rows: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as int64; ``exact``: doubles are known to hold them."""
    return (rows @ query).astype(np.int64) if exact else rows.astype(np.int64) @ query.astype(np.int64)


@dataclass
class Page:
    """``far``: distance of each entry to the page's pivot. Inner pages have pivots, radii and pages below; leaves have rows.

    An inner page above leaves has ``flat``: all their rows, the rows' distances, and the leaf of each.
    """

    far: np.ndarray
    rows: np.ndarray | None = None
    pivots: np.ndarray | None = None
    radii: np.ndarray | None = None
    below: list[Page] | None = None
    flat: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


class MTree:
    def __init__(self, ids: np.ndarray, rows: np.ndarray, s: Settings):
        self.ids, self.rows, self.s = ids, rows, s
        norms = (rows * rows).sum(axis=1)
        self.top = float(norms.max(initial=0.0))
        self.high = float(np.abs(rows).max(initial=0.0))
        self.points = np.column_stack([rows, np.sqrt(np.maximum(0.0, self.top - norms))])
        self.pivot = self.points[0]
        self.computed = 0  # distances and products of all searches
        self.root = self._page(np.arange(len(ids)), self.pivot)

    def _far(self, at: np.ndarray, pivot: np.ndarray) -> np.ndarray:
        d = self.points[at] - pivot
        return np.sqrt((d * d).sum(axis=1))

    def _page(self, at: np.ndarray, pivot: np.ndarray) -> Page:
        if len(at) <= self.s.page:
            return Page(self._far(at, pivot), rows=at)
        n = min(self.s.fan_out, -(-len(at) // self.s.page))
        own = self.points[at]
        pivots = own[np.linspace(0, len(at) - 1, n).astype(int)]
        for _ in range(ROUNDS):  # from the middle of each part, so that covering radii get small
            nearest = np.argmax(own @ pivots.T, axis=1)  # equally long, so the highest product is the nearest
            sums = np.stack([own[nearest == i].sum(axis=0) if (nearest == i).any() else pivots[i] for i in range(n)])
            pivots = own[np.argmax(own @ sums.T, axis=0)]
        nearest = np.argmax(own @ pivots.T, axis=1)
        if np.bincount(nearest, minlength=n).max() > 0.9 * len(at):  # equal or nearly equal vectors: any even parts will do
            nearest = np.arange(len(at)) * n // len(at)
        parts = [at[nearest == i] for i in range(n)]
        kept = [i for i in range(n) if len(parts[i])]
        below = [self._page(parts[i], pivots[i]) for i in kept]
        radii = np.asarray([self._far(parts[i], pivots[i]).max() for i in kept])
        d = pivots[kept] - pivot
        page = Page(np.sqrt((d * d).sum(axis=1)), pivots=pivots[kept], radii=radii, below=below)
        leaves = [(i, p) for i, p in enumerate(below) if p.rows is not None]
        if len(leaves) > 1:
            page.flat = (np.concatenate([p.rows for _, p in leaves]), np.concatenate([p.far for _, p in leaves]), np.repeat([i for i, _ in leaves], [len(p.rows) for _, p in leaves]))
        return page

    def search(self, own: int, query: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k`` rows of another id that score at least ``least``; ties to smaller ids."""
        k, square = self.s.k, float(query @ query)
        wide = np.append(query, 0.0)
        exact = self.high * float(np.abs(query).max(initial=0.0)) * max(1, len(query)) < 2**53
        total = square + self.top
        blur = MARGIN * (1.0 + np.sqrt(total))

        def bound(gap):
            """Highest score at a distance of at least ``gap``."""
            gap = np.maximum(0.0, gap - blur)
            return (total - gap * gap) / 2 + MARGIN * (1.0 + total)

        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)

        def take(near):
            nonlocal ids, scores, least
            near = near[self.ids[near] != own]
            got = exact_products(self.rows[near], query, exact)
            self.computed += len(near)
            good = got >= least
            ids, scores = np.append(ids, self.ids[near[good]]), np.append(scores, got[good])
            order = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[order], scores[order]
            if len(scores) == k:
                least = max(least, float(scores[-1]))

        first = self.pivot - wide
        heap, tie = [(-np.inf, 0, float(np.sqrt(first @ first)), self.root)], 0
        while heap:
            best, _, gap, page = heapq.heappop(heap)
            if -best < least:
                break
            if page.rows is not None:
                take(page.rows[bound(np.abs(gap - page.far)) >= least])
                continue
            at = np.flatnonzero(bound(np.abs(gap - page.far) - page.radii) >= least)
            d = page.pivots[at] - wide
            far = np.sqrt((d * d).sum(axis=1))
            self.computed += len(at)
            tops = bound(far - page.radii[at])
            together = page.flat is not None and 2 * (tops >= least).sum() >= len(page.below)
            if together:  # most pages are open: all rows of the leaves in one product, each by its own stored distance
                rows, stored, leaf = page.flat
                gaps = np.full(len(page.below), np.inf)
                gaps[at[tops >= least]] = far[tops >= least]
                take(rows[bound(np.abs(gaps[leaf] - stored)) >= least])
            for i, f, b in zip(at, far, tops, strict=True):
                if b >= least and not (together and page.below[i].rows is not None):
                    tie += 1
                    heapq.heappush(heap, (-float(b), tie, float(f), page.below[i]))
        return ids, scores


def _query_blocks(queries: DataFrame, s: Settings) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Blocks of queries by vector length: numbers, ids and rows. Equal queries count once."""
    number, batch = 0, []

    def block():
        nonlocal number
        ids, vectors = zip(*batch, strict=True)
        out = {}
        kind = queries.schema["vector"].dataType.elementType
        form = pa.list_(pa.float32() if kind.typeName() == "float" else pa.float64())
        for n, (own, rows) in whole_numbers(pa.array(ids, pa.int64()), pa.array(vectors, form)).items():
            out[n] = np.arange(number, number + len(own)), own, rows
            number += len(own)
        return out

    for r in queries.distinct().toLocalIterator():
        batch.append((r["id"], r["vector"]))
        if len(batch) == s.query_rows:
            yield block()
            batch = []
    if batch:
        yield block()


def _reached(block: dict, k: int) -> dict[int, np.ndarray]:
    """For each query a score that k other vectors of its block are known to reach, else minus infinity."""
    out = {}
    for n, (_, ids, rows) in block.items():
        least = np.full(len(ids), -np.inf)
        exact = float(np.abs(rows).max(initial=0.0)) ** 2 * max(1, n) < 2**53
        if exact and len(np.unique(ids)) == len(ids) > k:
            products = rows @ rows.T
            np.fill_diagonal(products, -np.inf)
            least = np.partition(products, -k, axis=1)[:, -k]
        out[n] = least
    return out


def top_k(vectors: DataFrame, is_query, s: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row that satisfies ``is_query`` the ``k`` rows of another id with the highest inner product.

    Returns ``(query_id, rank, vec_id, score)``; ranks start at 1, ties go to the smaller id, and a query with fewer
    candidates has fewer rows. Rows without id, and vectors that are null or hold a null or non-finite
    component, take no part. Only vectors of equal length are compared. Rows that repeat an id are candidates each
    by itself, but never of a query of that id; queries that repeat id and vector count once. Other columns are ignored.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"))
    parts, written = [], []
    for block in _query_blocks(vectors.where(is_query).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector")), s):
        shared = spark.sparkContext.broadcast((block, _reached(block, s.k)))
        parts.append(_nearest(own, shared, s))
        if len(parts) > 1:  # many blocks: each is done and written before the next begins
            parts[-2:] = [p if any(p is w for w in written) else materialize(p) for p in parts[-2:]]
            written += parts[-2:]
    if not parts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= s.k)
            .select("query_id", "rank", "vec_id", "score"))


def _nearest(vectors: DataFrame, shared, s: Settings) -> DataFrame:
    """The best rows of each tree for each query of the block."""
    schema = pa.schema([("number", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, least = shared.value
        table = pa.Table.from_batches(held).combine_chunks()
        for n, (ids, rows) in whole_numbers(table.column(0).combine_chunks(), table.column(1).combine_chunks()).items():
            if n not in block:
                continue
            tree = MTree(ids, rows, s)
            out = []
            for number, own, query, low in zip(*block[n], least[n], strict=True):
                found, scores = tree.search(int(own), query, low)
                out += [(int(number), int(own), int(i), int(x)) for i, x in zip(found, scores, strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for low in range(0, len(batch), s.tree_rows):
                part = batch.slice(low, s.tree_rows)
                if held and size + len(part) > s.tree_rows:
                    yield from search(held)
                    held, size = [], 0
                held.append(part)
                size += len(part)
        if held:
            yield from search(held)

    return vectors.mapInArrow(run, "number bigint, query_id bigint, vec_id bigint, score bigint")
