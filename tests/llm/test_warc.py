"""Archives read back as they were written."""

import base64
import hashlib
import io

import pytest
import zstandard
from pyarrow import fs
from pyspark.sql import functions as F

from evenkeel.llm import warc

PAGES = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (9, None, "same"), (3, "http://ü/\r\nX: y", "WARC/1.1\r\n\r\n"), (4, "http://b", ""), (5, "http://c", None),
         (6, "http://d", "ß" * 3_000), (7, "http://d", "x" * 300_000), (8, "", "x" * 300_000), (10, "u", "one"), (10, "u", "one"), (11, "u", "one"),
         (11, "u", "two"), (None, "u", "two"), (None, "u", "three"), (None, "u", "three")]


def plain(rows, least=0):
    out = []
    for name, _, html in rows:
        data = (html or "").encode()
        same = [i for i, _, h in rows if (h or "").encode() == data and i is not None]
        last = max(same, default=None)
        revisit = len(data) >= least and last is not None and name != last
        out.append((name, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"id": F.lit("clash"), "payload": F.lit(1)}).repartition(3)


@pytest.mark.parametrize("s", [warc.Settings(), warc.Settings(frame=400, bundle=600), warc.Settings(least=4)])
@pytest.mark.parametrize("limit", [None, 0])
def test_round_trip(spark, tmp_path, s, limit):
    if limit is not None:
        spark.conf.set("evenkeel.broadcast.rows", limit)
    try:
        index = warc.archive(table(spark, PAGES), str(tmp_path), s)
        got = warc.read_bundles(index).collect()
    finally:
        spark.conf.unset("evenkeel.broadcast.rows")
    assert sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == plain(PAGES, s.least)
    payloads = {(i, (h or "").encode()) for i, _, h in PAGES}
    for r in got:
        assert (r.id, bytes(r.payload)) in payloads if r.record_type == "response" else r.payload is None
    assert {r.url for r in got if r.id == 3} == {"http://%C3%BC/%0D%0AX:%20y"} and {r.url for r in got if r.id == 9} == {None}
    assert sorted((str(r.id), r.bundle, r.frame, r.start) for r in got) == sorted((str(r.id), r.bundle, r.frame, r.start) for r in index.collect())


def test_fetch_reads_named_records(spark, tmp_path):
    index = warc.archive(table(spark, PAGES), str(tmp_path), warc.Settings(frame=400))
    got = warc.fetch(index, spark.createDataFrame([(6,), (8,), (1,), (1,), (77,), (None,)], "id bigint")).collect()
    assert sorted((r.id, r.record_type, None if r.payload is None else len(r.payload)) for r in got) == [(1, "revisit", None), (6, "response", 6_000), (8, "response", 300_000)]


def test_a_bundle_is_a_plain_zstandard_file(spark, tmp_path):
    index = warc.archive(table(spark, PAGES), str(tmp_path), warc.Settings(frame=400))
    n = 0
    for path in {r.bundle for r in index.collect()}:
        with fs.LocalFileSystem().open_input_file(path) as f:
            frames = warc.read_seek_table(f)
            whole = b"".join(warc.read_frame(f, *x) for x in frames)
            f.seek(0)
            plain_read = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read()), read_across_frames=True).read()
        assert plain_read == whole
        at = 0
        while at < len(whole):
            _, at = warc.parse(whole, at)
            n += 1
    assert n == len(PAGES)


def test_damage_is_noticed(spark, tmp_path):
    index = warc.archive(table(spark, PAGES), str(tmp_path))
    path = index.first().bundle
    with open(path, "r+b") as f:
        f.seek(40)
        f.write(b"\x00\xff\x00\xff")
    with pytest.raises(Exception, match="frame|payload|record|Zstd|checksum"):
        warc.read_bundles(index).collect()


def test_empty(spark, tmp_path):
    index = warc.archive(table(spark, PAGES).limit(0), str(tmp_path))
    assert index.count() == 0 and warc.read_bundles(index).count() == 0
