import base64
import gzip
import hashlib
import random

import pytest

from tussis.llm import warc
from tussis.session import scratch_path

BIG = "<p>" + "x" * 200
ROWS = [
    (1, "http://a", "<html>small</html>", 0), (2, "http://b", "<html>small</html>", 0), (5, "http://c", BIG, 0), (3, None, BIG, 0), (9, "bad\r\nurl x", BIG, 0),
    (None, "http://n", BIG, 0), (3, "http://again", BIG, 0), (4, "é", None, 0), (6, "", "", 0), (None, "u", "y" * 100, 0), (None, "v", "y" * 100, 0),
    (7, "z", "WARC/1.1\r\n\r\n" + "é" * 300_000, 0), (8, "q", "z" * 99, 0), (10, "q", "z" * 99, 0),
]


def expected(rows):
    first = {}
    for i, _, html, _ in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        refers = first.get(html) if first.get(html) != i else None
        yield i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "page_id bigint, url string, html string, digest int")
    manifest = warc.write_archives(df.repartition(3), scratch_path(spark, "test-archives"))
    for size in (warc.RANGE_BYTES, 100, 7):
        got = warc.read_archives(manifest, size).collect()
        assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, expected(ROWS)))
    urls = {r.target_uri for r in got}
    assert "bad%0D%0Aurl%20x" in urls and None in urls and manifest.agg({"records": "sum"}).first()[0] == len(ROWS)


def test_members_are_ordinary_gzip(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    path = warc.write_archives(pages, scratch_path(spark, "test-archives")).first().path
    where, name = warc.opened(path)
    with where.open_input_file(name) as f:
        whole = gzip.decompress(f.read())
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") >= pages.count()


@pytest.mark.parametrize("span", [1, 10, 1000, 1 << 20])
def test_ranges_own_each_record_once(span):
    import io

    rng = random.Random(1)
    junk = bytes(rng.randrange(256) for _ in range(3000)) + warc.MAGIC * 5 + gzip.compress(b"no archive record")
    records = [warc.record_bytes(i, "u", hashlib.sha256(b"p" * i * 50).hexdigest(), b"p" * i * 50, None) for i in range(30)]
    data = b"".join(junk * (i % 3 == 0) + warc.member(r) for i, r in enumerate(records)) + warc.MAGIC
    got = [r for start in range(0, len(data), span) for r in warc.records_in(io.BytesIO(data), start, min(start + span, len(data)))]
    assert got == records


def test_damage_is_reported():
    record = warc.record_bytes(1, "u", "0" * 64, b"payload", None)
    good = warc.record_bytes(1, "u", hashlib.sha256(b"payload").hexdigest(), b"payload", None)
    for bad in (record, good[:-6], good.replace(b"Content-Length: 7\r", b"Content-Length: 9\r").replace(b"WARC-Payload", b"X-Payload"), b"WARC/1.1\r\n\r\n"):
        with pytest.raises(ValueError):
            [warc.parsed(*r) for r in warc.split_member(bad)]
    assert [warc.parsed(*r)[:4] for r in warc.split_member(good)] == [(1, 7, hashlib.sha256(b"payload").hexdigest(), "response")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read_archives(warc.write_archives(df, scratch_path(spark, "test-archives"))).count() == 0


def any_record(kind, block, *lines, version="WARC/1.0"):
    return "\r\n".join([version, f"WARC-Type:{kind}", *lines, f"content-length:  {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark):
    http = "Content-Type: application/http; msgtype=response"
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    chunked = b"HTTP/1.1 404 Not Found\r\nTransfer-Encoding: chunked\r\n\r\n5;x=1\r\nhello\r\n6\r\n world\r\n0\r\n\r\n"
    bare = b"HTTP/1.0 200 OK\nServer: x\n\nbody"
    records = [
        any_record("warcinfo", b"software: x\r\n", "WARC-Record-ID: <urn:uuid:1>", "Content-Type: application/warc-fields"),
        any_record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "WARC-Record-ID: <urn:uuid:2>", "Content-Type: application/http;msgtype=request"),
        any_record("response", chunked, "warc-record-id:<urn:uuid:3>", http, "WARC-Payload-Digest: " + sha1(b"hello world"), "WARC-Block-Digest: " + sha1(chunked)),
        any_record("response", bare, "WARC-Record-ID: <urn:page:77>", http, "WARC-Target-URI: http://a/", " b", "WARC-Payload-Digest: md5:" + hashlib.md5(b"body").hexdigest()),
        any_record("metadata", b"", "WARC-Record-ID: <urn:uuid:5>", "WARC-Payload-Digest: blake3:00"),
        any_record("resource", b"\x00\xff", "WARC-Record-ID: <urn:uuid:6>", "WARC-Date: 2020-01-01T00:00:00Z", "Content-Type: image/x", version="WARC/1.1"),
        any_record("response", b"HTTP/1.1 200 OK\r\nContent-Length: 50\r\n\r\ncut", "WARC-Record-ID: <urn:uuid:7>", http, "WARC-Truncated: length"),
        any_record("revisit", b"HTTP/1.1 200 OK\r\n\r\n", "WARC-Record-ID: <urn:page:x>", http, "WARC-Refers-To: <urn:uuid:3>", "WARC-Payload-Digest: sha1:ABC"),
    ]
    data = b"".join(map(warc.member, records[:4])) + warc.member(b"".join(records[4:]))
    folder = scratch_path(spark, "test-archives")
    where, base = warc.opened(folder)
    where.create_dir(base, recursive=True)
    with where.open_output_stream(f"{base}/other.warc.gz", compression=None) as f:
        f.write(data)
    files = spark.createDataFrame([(f"{folder}/other.warc.gz", len(data), "x")], "path string, length bigint, record_id string")
    for span in (warc.RANGE_BYTES, 50):
        rows = sorted(warc.read_archives(files, span).collect(), key=lambda r: r.record_id)
        got = [(r.record_id[5:-1], r.page_id, r.record_type, r.payload_bytes, r.http_status, r.refers_to, r.refers_to_id) for r in rows]
        assert got == [
            ("page:77", 77, "response", 4, 200, None, None), ("page:x", None, "revisit", None, 200, None, "<urn:uuid:3>"), ("uuid:1", None, "warcinfo", 13, None, None, None),
            ("uuid:2", None, "request", 0, None, None, None), ("uuid:3", None, "response", 11, 404, None, None), ("uuid:5", None, "metadata", 0, None, None, None),
            ("uuid:6", None, "resource", 2, None, None, None), ("uuid:7", None, "response", 3, 200, None, None),
        ]
        assert rows[4].payload_digest == hashlib.sha256(b"hello world").hexdigest() and rows[0].target_uri == "http://a/ b" and rows[1].payload_digest == "sha1:ABC"
        assert rows[6].date == "2020-01-01T00:00:00Z" and rows[6].content_type == "image/x" and rows[5].content_type is None
