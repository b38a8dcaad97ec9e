"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Vectors become whole numbers ``floor(256 * x)``. Rows are sorted by length of the vector, label and place on a Hilbert
curve through the first dimensions, and written as Parquet: pages of consecutive rows, gathered to zones. A zone map has the
least and greatest number of each dimension and the range of the labels. For an anchor ``a`` interval arithmetic
bounds every inner product in a zone: ``sum(max(a * low, a * high))`` from above, ``sum(min(...))`` from below. An anchor is sent to a
zone only if these bounds meet one of its windows: the scores from its fifth best known positive upwards, then for
each positive the scores from 80 % to 100 % of it. Pages are tested likewise while a zone is read, against what the
window has reached by then.

Anchors are held, candidates stream past them page by page: a task holds at most ``readers`` anchors and one page. Zones that more
anchors want are read by several tasks. The zone maps are the only thing sent to all tasks; zones grow with the
table so that the maps stay below ``map_bytes`` (and one zone for each partition of the sort).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.session import discard, materialize, shuffle_parts

LEAST, GREATEST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    """``page``: rows of a page; ``readers``: anchors that one task holds; ``key_dims`` and ``key_bits``: the Hilbert curve."""

    positives: int = 5
    negatives: int = 5
    page: int = 256
    zone_pages: int = 16
    map_bytes: int = 1 << 26
    readers: int = 1_024
    key_dims: int = 16
    key_bits: int = 3


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of cell numbers (below ``2 ** bits``) along the Hilbert curve; rows x dimensions <= 63 bits."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of every level, from the coarsest
        p = q - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(turned, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    last = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        last ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= last
    place = np.zeros_like(last)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def products(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows; ``OverflowError`` if one needs more than 64 bits."""
    most = float(np.abs(rows).max(initial=0.0)) * float(np.abs(others).max(initial=0.0)) * max(1, rows.shape[1])
    if most < 2**53:
        return (rows @ others.T).astype(np.int64)
    if most < 2**62:
        return rows.astype(np.int64) @ others.astype(np.int64).T
    whole = lambda m: np.asarray([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return (whole(rows) @ whole(others).T).astype(np.int64) if rows.shape[1] else np.zeros((len(rows), len(others)), np.int64)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector between ``low`` and ``high`` of each zone, widened for rounding."""
    up, down = np.maximum(anchors, 0.0), np.minimum(anchors, 0.0)
    least, greatest = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    slack = 1.0 + 1e-9 * (np.abs(anchors) @ np.maximum(np.abs(low), np.abs(high)).T)
    return least - slack, greatest + slack


def numbers(vectors: pa.Array, n: int) -> np.ndarray:
    flat = pc.list_flatten(vectors).cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(256.0 * flat).reshape(len(vectors), n)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))


def taking_part(rows: DataFrame, is_anchor: Column, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    own = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
                      F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vector_col).alias("vector"))
    own = own.where("id is not null and label is not null and vector is not null").where(F.forall("vector", good))
    return own.withColumn("n", F.size("vector"))


def _with_keys(rows: DataFrame, s: Settings) -> DataFrame:
    """Add ``key``, the place on the Hilbert curve; cells are cut at the mean and in steps of a deviation."""
    dims = [F.get("vector", F.lit(i)).cast("double") for i in range(s.key_dims)]
    told = rows.agg(*[F.avg(d) for d in dims], *[F.stddev_pop(d) for d in dims]).first()
    clean = lambda v: np.asarray([x if x is not None and np.isfinite(x) else 0.0 for x in v])
    mean, wide = clean(told[:s.key_dims]), clean(told[s.key_dims:])
    half, top = 1 << (s.key_bits - 1), (1 << s.key_bits) - 1
    step = np.where(wide > 0, 2.0 * wide / half, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key = batch.column("n").to_numpy(), np.zeros(len(batch), np.int64)
            for m in np.unique(n):
                at = np.flatnonzero(n == m)
                used = min(int(m), s.key_dims)
                if used:
                    flat = pc.list_flatten(batch.column("vector").take(pa.array(at))).cast(pa.float64()).to_numpy(zero_copy_only=False)
                    x = flat.reshape(len(at), int(m))[:, :used]
                    key[at] = hilbert_index(np.clip(np.floor((x - mean[:used]) / step[:used]) + half, 0, top), s.key_bits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], names=[*batch.schema.names, "key"])

    kind = rows.schema["vector"].dataType.simpleString()
    return rows.mapInArrow(run, f"id bigint, label bigint, anchor boolean, vector {kind}, n int, key bigint")


def build_index(rows: DataFrame, s: Settings) -> DataFrame:
    """The written index of ``rows(id, label, anchor, vector, n)``: kind 1 rows in Hilbert order, kind 0 zone maps.

    A row has its ``zone`` and its ``place`` there; an anchor has ``least``, the score of its last wanted positive within
    its page (or the least number of all): its true one is no lower.
    """
    size = rows.agg(F.count(F.lit(1)), F.max("n")).first()
    zones = max(1, s.map_bytes // (16 * max(1, size[1] or 0) + 64))
    pages = max(s.zone_pages, -(-size[0] // (zones * s.page)))
    parts = shuffle_parts(rows.sparkSession)
    order = ["n", "label", "key", "id"]
    ranged = _with_keys(rows, s).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    vector = rows.schema["vector"].dataType.simpleString()
    out_type = (f"kind int, n int, zone bigint, place bigint, id bigint, label bigint, anchor boolean, least bigint, vector {vector}, "
                "low array<double>, high array<double>, label_low bigint, label_high bigint")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    schema = to_arrow_schema(StructType.fromDDL(out_type))

    def page_rows(batch: pa.RecordBatch, zone: int, place: int, state: dict) -> pa.RecordBatch:
        n = batch.column("n")[0].as_py()
        x, labels = numbers(batch.column("vector"), n), batch.column("label").to_numpy()
        state["low"] = np.minimum(state["low"], x.min(axis=0)) if "low" in state else x.min(axis=0)
        state["high"] = np.maximum(state["high"], x.max(axis=0)) if "high" in state else x.max(axis=0)
        state["labels"] = (min(labels.min(), state.get("labels", (labels[0],))[0]), max(labels.max(), state.get("labels", (0, labels[0]))[1]))
        least = np.full(len(batch), LEAST, np.int64)
        anchors = np.flatnonzero(batch.column("anchor").to_numpy(zero_copy_only=False))
        if len(anchors):
            scores = products(x[anchors], x)
            for at, row in zip(anchors, scores, strict=True):
                fit = labels == labels[at]
                fit[at] = False
                if fit.sum() >= s.positives:
                    least[at] = np.partition(row[fit], -s.positives)[-s.positives]
        none = lambda t: pa.nulls(len(batch), t)
        fill = {"kind": pa.array(np.ones(len(batch), np.int32)), "zone": pa.array(np.full(len(batch), zone)),
                "place": pa.array(np.arange(place, place + len(batch))), "least": pa.array(least)}
        cols = [fill.get(f.name) if f.name in fill else batch.column(f.name) if f.name in batch.schema.names else none(f.type) for f in schema]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def zone_row(n: int, zone: int, state: dict) -> pa.RecordBatch:
        told = {"kind": 0, "n": n, "zone": zone, "low": state["low"].tolist(), "high": state["high"].tolist(),
                "label_low": int(state["labels"][0]), "label_high": int(state["labels"][1])}
        return pa.RecordBatch.from_pylist([told], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_held, number, place, state, now = [], 0, 0, 0, {}, None

        def flush():
            nonlocal held, size_held, place
            if size_held:
                page = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                yield page_rows(page, (part << 32) | number, place, state)
                place, held, size_held = place + size_held, [], 0

        def close():
            nonlocal number, place, state
            yield from flush()
            if state:
                yield zone_row(now, (part << 32) | number, state)
                number, place, state = number + 1, 0, {}

        part = None
        for batch in batches:
            if not len(batch):
                continue
            ns, at = batch.column("n").to_numpy(), 0
            part = batch.column("part")[0].as_py()
            while at < len(batch):
                if now != ns[at]:
                    yield from close()
                    now = int(ns[at])
                same = int(np.searchsorted(ns, now, side="right")) - at
                take = min(same, s.page - size_held)
                held.append(batch.slice(at, take))
                size_held, at = size_held + take, at + take
                if size_held == s.page:
                    yield from flush()
                    if place >= pages * s.page:
                        yield from close()
        if part is not None:
            yield from close()

    return materialize(ranged.mapInArrow(run, out_type))


class Zones:
    """The zone maps of vectors of one length."""

    def __init__(self, rows: list):
        self.zone = np.asarray([r["zone"] for r in rows], np.int64)
        self.low, self.high = (np.asarray([r[c] for r in rows], float).reshape(len(rows), len(rows[0][c])) for c in ("low", "high"))
        self.labels = np.asarray([[r["label_low"], r["label_high"]] for r in rows], np.int64)

    def wanted(self, x: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool) -> np.ndarray:
        """Which zones (columns) each anchor (row) must read for any of its windows ``low`` to ``high``."""
        least, greatest = bounds(x, self.low, self.high)
        first, last = self.labels[None, :, 0], self.labels[None, :, 1]
        own = labels[:, None]
        fits = (first <= own) & (own <= last) if same else (first != own) | (last != own)
        meets = np.zeros(fits.shape, bool)
        for w in range(low.shape[1]):
            meets |= (greatest >= low[:, w:w + 1]) & (least <= high[:, w:w + 1])
        return fits & meets


def padded(lists: pa.Array, fill: int) -> np.ndarray:
    rows = lists.to_pylist()
    out = np.full((len(rows), max(map(len, rows), default=0)), fill, np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _route(anchors: DataFrame, zones, same: bool) -> DataFrame:
    """A row for each zone that an anchor must read."""
    vector = anchors.schema["vector"].dataType.simpleString()
    out_type = f"zone bigint, own_zone bigint, own_place bigint, id bigint, label bigint, n int, vector {vector}, low array<bigint>, high array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = zones.value
        for whole in batches:
            for start in range(0, len(whole), 256):
                part = whole.slice(start, 256)
                ns = part.column("n").to_numpy()
                for n in np.unique(ns):
                    if int(n) not in maps:
                        continue
                    own = part.take(pa.array(np.flatnonzero(ns == n)))
                    x = numbers(own.column("vector"), int(n))
                    low, high = padded(own.column("low"), GREATEST), padded(own.column("high"), LEAST)
                    who, where = np.nonzero(maps[int(n)].wanted(x, own.column("label").to_numpy(), low, high, same))
                    for at in range(0, len(who), 4_096):
                        out = own.take(pa.array(who[at:at + 4_096]))
                        yield pa.RecordBatch.from_arrays([pa.array(maps[int(n)].zone[where[at:at + 4_096]]), *out.columns],
                                                         names=["zone", *out.schema.names])

    return anchors.select("own_zone", "own_place", "id", "label", "n", "vector", "low", "high").mapInArrow(run, out_type)


class Readers:
    """Anchors that read one zone, with the best rows of each of their windows so far."""

    def __init__(self, rows: list[pa.RecordBatch], same: bool, k: int):
        t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        self.same, self.k = same, k
        self.n = t.column("n")[0].as_py()
        self.x, self.labels = numbers(t.column("vector"), self.n), t.column("label").to_numpy()
        self.own = np.column_stack([t.column("own_zone").to_numpy(), t.column("own_place").to_numpy()])
        self.low, self.high = padded(t.column("low"), GREATEST), padded(t.column("high"), LEAST)
        nothing = np.empty(0, np.int64)
        self.found = {}
        self.nothing = (nothing, nothing)

    def read(self, zone: int, places: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        page = Zones([{"zone": zone, "low": x.min(axis=0), "high": x.max(axis=0), "label_low": labels.min(), "label_high": labels.max()}])
        at = np.flatnonzero(page.wanted(self.x, self.labels, self.low, self.high, self.same)[:, 0])
        for start in range(0, len(at), 256):
            some = at[start:start + 256]
            scores = products(self.x[some], x)
            fits = labels[None, :] == self.labels[some, None] if self.same else labels[None, :] != self.labels[some, None]
            if self.same:
                mine = (self.own[some, 0] == zone)[:, None] & (self.own[some, 1][:, None] == places[None, :])
                fits &= ~mine
            for w in range(self.low.shape[1]):
                good = fits & (scores >= self.low[some, w:w + 1]) & (scores <= self.high[some, w:w + 1])
                for i in np.flatnonzero(good.any(axis=1)):
                    self._keep(int(some[i]), w, scores[i, good[i]], ids[good[i]])

    def _keep(self, anchor: int, window: int, scores: np.ndarray, ids: np.ndarray) -> None:
        old_scores, old_ids = self.found.get((anchor, window), self.nothing)
        scores, ids = np.append(old_scores, scores), np.append(old_ids, ids)
        order = best(scores, ids, self.k)
        self.found[anchor, window] = scores[order], ids[order]
        if len(order) == self.k:
            self.low[anchor, window] = scores[order[-1]]

    def result(self) -> pa.RecordBatch | None:
        out = [(*self.own[a], w, i, x) for (a, w), (scores, ids) in self.found.items() for i, x in zip(ids, scores, strict=True)]
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in zip(*out, strict=True)], names=FOUND)


FOUND = ["own_zone", "own_place", "window", "other", "score"]


def _read_zones(rows: DataFrame, same: bool, k: int, s: Settings) -> DataFrame:
    """The best rows of each window within each zone; ``rows`` are sorted by zone and copy, anchors (kind 0) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, readers = None, [], None
        for batch in batches:
            zones, salts, kinds = (batch.column(c).to_numpy() for c in ("zone", "salt", "kind"))
            cuts = np.flatnonzero((np.diff(zones) != 0) | (np.diff(salts) != 0) | (np.diff(kinds) != 0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                key, part = (zones[start], salts[start]), batch.slice(start, stop - start)
                if key != now:
                    if readers is not None and (told := readers.result()) is not None:
                        yield told
                    now, waiting, readers = key, [], None
                if kinds[start] == 0:
                    waiting.append(part)
                    continue
                if readers is None and not waiting:  # no anchor has this copy's number
                    continue
                if readers is None:
                    readers, waiting = Readers(waiting, same, k), []
                for at in range(0, len(part), s.page):
                    page = part.slice(at, s.page)
                    readers.read(int(key[0]), page.column("own_place").to_numpy(), page.column("id").to_numpy(), page.column("label").to_numpy(),
                                 numbers(page.column("vector"), readers.n))
        if readers is not None and (told := readers.result()) is not None:
            yield told

    return rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in FOUND))


def _search(index: DataFrame, anchors: DataFrame, zones, same: bool, k: int, s: Settings) -> DataFrame:
    """The ``k`` best rows of each window of ``anchors(own_zone, own_place, id, label, n, vector, low, high)``: FOUND and ``rank``."""
    parts = shuffle_parts(index.sparkSession)
    routed = materialize(_route(anchors, zones, same))
    copies = routed.groupBy("zone").agg(F.ceil(F.count(F.lit(1)) / s.readers).cast("bigint").alias("copies"))
    copies = F.broadcast(copies)  # at most one row for each zone map
    read = routed.join(copies, "zone").select(
        "zone", F.pmod(F.xxhash64("own_zone", "own_place"), "copies").alias("salt"), F.lit(0).alias("kind"), "own_zone", "own_place", "id", "label",
        "n", "vector", "low", "high")
    none = F.lit(None).cast("array<bigint>")
    held = index.where("kind = 1").join(copies, "zone").select(
        "zone", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("salt"), F.lit(1).alias("kind"), F.col("zone").alias("own_zone"),
        F.col("place").alias("own_place"), "id", "label", "n", "vector", none.alias("low"), none.alias("high"))
    rows = read.unionByName(held).repartition(parts, "zone", "salt").sortWithinPartitions("zone", "salt", "kind", "own_place")
    found = _read_zones(rows, same, k, s)
    top = Window.partitionBy("own_zone", "own_place", "window").orderBy(F.desc("score"), "other")
    out = materialize(found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k))
    discard(routed)
    return out


def mine(rows: DataFrame, is_anchor: Column, s: Settings = Settings(), id_col: str = "vec_id", label_col: str = "label",
         vector_col: str = "embedding") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for every anchor and positive.

    A row's score is its integer inner product with the anchor. An anchor's positives are its first ``positives`` other
    rows of the same label by score, ties by smaller id; for each of them the first ``negatives`` rows of other labels
    with 80 % to 100 % of the positive's score are returned (none for a negative positive score: the window is empty).

    Rows without id or label, and vectors that are null or hold a null or non-finite component, take no part. Only vectors
    of equal length are compared; empty ones score 0. Rows that repeat an id are rows of their own: an anchor leaves out only
    itself. Labels are whole numbers. Scores beyond 64 bits raise ``OverflowError``. Other columns are ignored.
    """
    spark = rows.sparkSession
    index = build_index(taking_part(rows, is_anchor, id_col, label_col, vector_col), s)
    by_length: dict[int, list] = {}
    for r in index.where("kind = 0").select("n", "zone", "low", "high", "label_low", "label_high").collect():  # bounded by map_bytes
        by_length.setdefault(r["n"], []).append(r)
    zones = spark.sparkContext.broadcast({n: Zones(told) for n, told in by_length.items()})
    anchors = index.where("kind = 1 and anchor").select(
        F.col("zone").alias("own_zone"), F.col("place").alias("own_place"), "id", "label", "n", "vector", "least")
    end = F.lit(GREATEST).cast("bigint")
    positives = _search(index, anchors.withColumns({"low": F.array("least"), "high": F.array(end)}), zones, True, s.positives, s)
    p = F.col("score")
    windows = positives.where(p >= 0).groupBy("own_zone", "own_place").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("w"))
    windows = windows.select("own_zone", "own_place", F.transform("w", lambda x: x["score"]).alias("high"))
    windows = windows.withColumn("low", F.expr("transform(high, p -> p - p div 5)"))  # the least whole number from 80 % of p on
    wanting = anchors.drop("least").join(windows, ["own_zone", "own_place"])
    negatives = _search(index, wanting, zones, False, s.negatives, s)
    own = anchors.select("own_zone", "own_place", F.col("id").alias("anchor_id"))
    pairs = positives.select("own_zone", "own_place", (F.col("rank") - 1).cast("bigint").alias("window"), F.col("other").alias("positive_id"),
                             p.alias("positive_score"))
    return (negatives.join(pairs, ["own_zone", "own_place", "window"]).join(own, ["own_zone", "own_place"])
            .select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
