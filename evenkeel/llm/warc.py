"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with some whole records, and a seek table behind them: a skippable frame
with the compressed and plain size of every frame and a footer, as the seekable Zstandard format has it. Any reader of
``.warc.zst`` files can read it from the start; with the table one frame can be read by itself.

``write_bundles`` returns the index of what it wrote: for each record its bundle, frame, and place within the plain frame. A
bundle's name holds the attempt that wrote it, and only bundles named by the written index count, so what a lost or
repeated task leaves behind is never read. ``fetch`` reads single records, ``read_bundles`` whole bundles, spread over frames.

Payloads that were seen before become revisit records without payload. Of equal payloads (equal SHA-256) the one with the largest id
is the response; only ids and digests are shuffled to find it. Folders may lie in any store that pyarrow and Spark both reach.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import utf8
from evenkeel.session import broadcast_rows_limit, discard, materialize, shuffle_parts

# Fixed values of the formats: skippable frame of the seek table, its last number, the base profile of revisits.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_URN = "urn:record:"


@dataclass(frozen=True)
class Settings:
    """``frame``: plain bytes after which a frame ends; ``bundle``: compressed bytes after which a file ends; ``least``: payload bytes
    from which equal payloads become revisits."""

    frame: int = 1 << 20
    bundle: int = 1 << 28
    least: int = 0
    level: int = 3
    date: str = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- records -------------------------------------------------------------------------------------

def record(name: int | None, url: str | None, payload: bytes, refers_to: int | None, response: bool, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP head, whose Content-Length is that of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if response else http
    urn = f"{ID_URN}{name}" if name is not None else f"urn:uuid:{uuid.uuid4()}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: <{urn}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url.encode("utf-8", "surrogatepass"), safe="!#$%&'()*+,/:;=?@[]~"))
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if not response:
        head += [f"WARC-Profile: {PROFILE}", *([f"WARC-Refers-To: <{ID_URN}{refers_to}>"] if refers_to is not None else [])]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that starts at ``at`` and the place behind it."""
    end = data.index(b"\r\n\r\n", at)
    if not data.startswith(b"WARC/1.", at):
        raise ValueError(f"no WARC record at {at}")
    head = {k.decode().lower(): v.decode() for k, v in FIELD.findall(data, data.index(b"\r\n", at) + 2, end + 2)}
    start, size = end + 4, int(head["content-length"])
    block = data[start:start + size]
    stop = start + size + 4
    if len(block) != size or data[stop - 4:stop] != b"\r\n\r\n":
        raise ValueError(f"cut record at {at}")
    split = block.index(b"\r\n\r\n") + 4
    http = {k.decode().lower(): v.decode() for k, v in FIELD.findall(block, block.index(b"\r\n") + 2, split - 2)}
    named = lambda urn: int(urn[len(ID_URN) + 1:-1]) if urn and urn.startswith("<" + ID_URN) else None
    kind = head["warc-type"]
    return {"id": named(head["warc-record-id"]), "record_type": kind, "url": head.get("warc-target-uri"),
            "payload_digest": head["warc-payload-digest"].removeprefix("sha1:"), "refers_to": named(head.get("warc-refers-to")),
            "payload_bytes": int(http["content-length"]), "payload": block[split:] if kind == "response" else None}, stop


# --- bundles -------------------------------------------------------------------------------------

def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame with (compressed, plain) sizes, little-endian, and its footer."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(source) -> list[tuple[int, int, int]]:
    """(offset, compressed, plain size) of every frame of an opened bundle."""
    size = source.size()
    source.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    source.seek(size - 9 - n * entry - 8)
    kind, length = struct.unpack("<II", source.read(8))
    if kind != SKIPPABLE or length != n * entry + 9:
        raise ValueError("damaged seek table")
    body, out, at = source.read(n * entry), [], 0
    for k in range(n):
        compressed, plain = struct.unpack_from("<II", body, k * entry)
        out.append((at, compressed, plain))
        at += compressed
    return out


def read_frame(source, offset: int, compressed: int, plain: int) -> bytes:
    source.seek(offset)
    data = zstandard.ZstdDecompressor().decompress(source.read(compressed), max_output_size=plain)
    if len(data) != plain:
        raise ValueError("damaged frame")
    return data


def opened(path: str):
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


class Bundle:
    """A bundle being written: records go to frames, frames to the file."""

    def __init__(self, folder: str, s: Settings):
        self.s, self.path = s, f"{folder}/{uuid.uuid4().hex}.warc.zst"
        store, inner = fs.FileSystem.from_uri(self.path)
        if isinstance(store, fs.LocalFileSystem):
            store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        self.out = store.open_output_stream(inner, compression=None)
        self.packer = zstandard.ZstdCompressor(level=s.level, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.waiting, self.size, self.written = [], 0, 0

    def add(self, data: bytes) -> tuple[str, int, int, int]:
        """Place of the record: bundle, frame, offset within the plain frame, length."""
        if self.size and self.size + len(data) > self.s.frame:
            self._frame()
        spot = (self.path, len(self.frames), self.size, len(data))
        self.waiting.append(data)
        self.size += len(data)
        return spot

    def _frame(self) -> None:
        if self.waiting:
            packed = self.packer.compress(b"".join(self.waiting))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.waiting, self.size = [], 0

    def full(self) -> bool:
        return self.written >= self.s.bundle

    def close(self) -> None:
        self._frame()
        self.out.write(seek_table(self.frames))
        self.out.close()


INDEX = "id bigint, bundle string, frame int, start bigint, length bigint"


def write_bundles(rows: DataFrame, folder: str, s: Settings = Settings()) -> DataFrame:
    """Write a record for each of ``rows(id, url, payload, refers_to, response)`` and return the written index."""
    folder = folder.rstrip("/")
    schema = pa.schema([("id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, spots = None, []
        for batch in batches:
            for name, url, payload, refers_to, response in zip(*(batch.column(c) for c in ("id", "url", "payload", "refers_to", "response")), strict=True):
                bundle = bundle or Bundle(folder, s)
                data = record(name.as_py(), url.as_py(), utf8(payload.as_py()), refers_to.as_py(), response.as_py(), s.date)
                spots.append((name.as_py(), *bundle.add(data)))
                if bundle.full():
                    bundle.close()
                    bundle = None
            if spots:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*spots, strict=True), schema, strict=True)], schema=schema)
                spots = []
        if bundle:
            bundle.close()

    return materialize(rows.select("id", "url", "payload", "refers_to", "response").mapInArrow(run, INDEX))


READ = ("id bigint, record_type string, url string, payload_digest string, refers_to bigint, payload_bytes bigint, payload binary, "
        "bundle string, frame int, start bigint")


def _records(places: DataFrame, payloads: bool) -> DataFrame:
    """Records of ``places(bundle, frame, starts)``: those at ``starts``, or the whole frame where that is null. Payloads are checked."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    schema = to_arrow_schema(StructType.fromDDL(READ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source, table = None, None, []
        for batch in batches:
            for place in batch.to_pylist():
                if place["bundle"] != path:
                    path = place["bundle"]
                    source = opened(path)
                    table = read_seek_table(source)
                data, out, size = read_frame(source, *table[place["frame"]]), [], 0
                starts, at, n = place["starts"], 0, 0
                while (at < len(data)) if starts is None else (n < len(starts)):
                    at = at if starts is None else starts[n]
                    told, stop = parse(data, at)
                    payload = told["payload"]
                    if payload is not None and (payload_digest(payload) != told["payload_digest"] or len(payload) != told["payload_bytes"]):
                        raise ValueError(f"damaged payload of record {told['id']}")
                    out.append(told | {"payload": payload if payloads else None, "bundle": path, "frame": place["frame"], "start": at})
                    at, n = stop, n + 1
                for k in range(0, len(out), 1_000):
                    yield pa.RecordBatch.from_pylist(out[k:k + 1_000], schema=schema)

    # by a hash: dealing by the grouping keys themselves would be dropped as done already, and adaptive execution would then merge these small rows into one task
    key = F.xxhash64("bundle", "frame")
    dealt = places.select("bundle", "frame", "starts").repartition(shuffle_parts(places.sparkSession), key).sortWithinPartitions("bundle", "frame")
    return dealt.mapInArrow(run, READ)


def read_bundles(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the bundles that ``index`` names, read frame by frame; frames are spread over all tasks."""
    frames = index.select("bundle", "frame").distinct().withColumn("starts", F.lit(None).cast("array<bigint>"))
    return _records(frames, payloads)


def fetch(index: DataFrame, ids: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of ``ids(id)``: only frames that hold one are read, and only those records of a frame are taken."""
    wanted = index.join(ids.select("id").distinct(), "id", "left_semi")
    return _records(wanted.groupBy("bundle", "frame").agg(F.array_sort(F.collect_set("start")).alias("starts")), payloads)


# --- revisits ------------------------------------------------------------------------------------

def with_revisits(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Add ``response`` and ``refers_to`` to ``rows(id, url, payload)``: revisits of the largest id among equal payloads.

    Only (id, digest) of payloads that repeat is joined back. Rows of the largest id are all responses, so are rows without
    id if no equal payload has one; else they revisit it. The join is a broadcast for up to ``evenkeel.broadcast.rows`` revisits, and by id beyond it.
    """
    spark = rows.sparkSession
    size, digest = F.octet_length(F.coalesce("payload", F.lit(""))), F.sha2(F.coalesce("payload", F.lit("")), 256)
    digests = materialize(rows.where(size >= s.least).select("id", digest.alias("digest")))
    repeated = digests.groupBy("digest").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("rows")).where("rows > 1 and last is not null")
    repeated = materialize(repeated)
    total = digests.count()
    # payloads with more than a thousandth of all rows: at most a thousand, sent to all tasks so that none is dealt by its digest
    hot = F.broadcast(repeated.where(F.col("rows") * 1_000 > total).drop("rows"))
    cold = repeated.where(F.col("rows") * 1_000 <= total).drop("rows")
    pairs = digests.join(hot, "digest").unionByName(digests.join(cold, "digest"))
    older = materialize(pairs.where("id is null or id <> last").distinct())
    small = older.count() <= broadcast_rows_limit(spark)
    older = older.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.col("last").alias("refers_to"))
    keyed = rows.withColumn("_own", F.when(size >= s.least, digest))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_digest"))
    out = keyed.join(F.broadcast(older) if small else older, same, "left")
    out = out.select(*rows.columns, "refers_to", F.col("_digest").isNull().alias("response"))
    discard(digests, repeated)
    return out


def archive(pages: DataFrame, folder: str, s: Settings = Settings(), id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` as WARC bundles to ``folder`` and return the index ``(id, bundle, frame, start, length)``.

    The payload is the text in UTF-8, a null one is empty; a null url has no target, control characters in one are escaped. Equal
    payloads of at least ``least`` bytes are responses once, at the largest id, and revisits else; rows that repeat id and
    payload are written each, as the same kind. A row without id has a random record id and reads back as null. Other columns are ignored.
    """
    own = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("payload"))
    return write_bundles(with_revisits(own, s), folder, s)
