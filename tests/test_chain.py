"""Fetching with ranges and retries, the transform chain, counters over batches."""

import random
import struct
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from weirstream.functions import binary
from weirstream.sources import fetch, pages, transport
from weirstream.streaming import sink

BODY = bytes(random.Random(9).randbytes(5000))


class Handler(BaseHTTPRequestHandler):
    """/whole, /ranged, /broken (half a body once), /busy (503 once, with a date), /gone, /echo (a header)."""

    seen: dict = {}

    def do_HEAD(self):
        self.send_response(200)
        self.send_header("Content-Length", str(len(BODY)))
        self.end_headers()

    def do_GET(self):
        nth = self.seen[self.path] = self.seen.get(self.path, 0) + 1
        body, code, size = BODY, 200, None
        asked = self.headers.get("Range")
        if asked and not self.path.startswith("/whole"):
            a, b = asked.removeprefix("bytes=").split("-")
            body, code = BODY[int(a) : int(b) + 1 if b else None], 206
        if self.path == "/broken" and nth == 1:
            body, size = body[:2000], len(body)
        if self.path == "/echo":
            body = (self.headers.get("Cookie") or "").encode()
        if self.path == "/key16":
            body = BODY[:8] + (self.headers.get("Cookie") or "").encode()
        if self.path == "/gone" or (self.path == "/busy" and nth == 1):
            code, body = (404 if self.path == "/gone" else 503), b""
        self.send_response(code)
        self.send_header("Content-Length", str(size or len(body)))
        if code == 503:
            self.send_header("Retry-After", "Wed, 21 Oct 2015 07:28:00 GMT")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_retry_after():
    assert fetch.wait_of("7") == 7 and fetch.wait_of("900") == 30 and fetch.wait_of("-3") == 0
    assert fetch.wait_of("Wed, 21 Oct 2015 07:28:00 GMT") == 0 and fetch.wait_of("soon") == 0 and fetch.wait_of(None) == 0


def test_replies(site):
    assert fetch.get(f"{site}/ranged", (10, 19))[1:3] == (206, BODY[10:20])
    assert fetch.get(f"{site}/ranged", (4990, -1))[2] == BODY[4990:]
    assert fetch.get(f"{site}/whole", (10, 19))[1:3] == (200, BODY[10:20])
    assert fetch.get(f"{site}/broken")[2] == BODY and Handler.seen["/broken"] == 2
    final, status, body, length, pressure, error = fetch.get(f"{site}/busy")
    assert (status, body, pressure, error) == (200, BODY, 1, "")
    assert fetch.get(f"{site}/gone")[1:] == (404, None, None, 0, "HTTP 404")
    assert fetch.get(f"{site}/ranged", method="HEAD")[1:4] == (200, None, 5000)


def test_source_and_requests(spark, site):
    fetch.register(spark)
    read = spark.read.format("fetch").option("urls", f"{site}/ranged\t0-9\n{site}/echo").option("headers", "Cookie: a=1").load()
    got = {r.url: bytes(r.body) for r in read.collect()}
    assert got == {f"{site}/ranged": BODY[:10], f"{site}/echo": b"a=1"}
    asked = spark.createDataFrame([(f"{site}/ranged", (5, 8), None), (f"{site}/echo", None, {"Cookie": "b=2"}), (None, None, None)], "url string, span struct<start:long,end:long>, headers map<string,string>")
    rows = fetch.fetched(asked).collect()
    assert [r.body and bytes(r.body) for r in rows] == [BODY[5:9], b"b=2", None] and rows[0].span.end == 8


def test_download_goes_on(spark, site):
    files = spark.createDataFrame([(1, f"{site}/ranged", 5000), (2, f"{site}/whole", None), (3, f"{site}/ranged", 0)], "stream_id long, url string, length long")
    pieces = fetch.file_ranges(files, 1500)
    assert [(r.stream_id, r.idx, r.span.start, r.span.end) for r in pieces.orderBy("stream_id", "idx").collect()] == [(1, 0, 0, 1499), (1, 1, 1500, 2999), (1, 2, 3000, 4499), (1, 3, 4500, 4999), (2, 0, 0, -1)]
    left = fetch.missing(pieces, pieces.filter("idx IN (0, 2)"))
    bodies = {(r.span.start): bytes(r.body) for r in fetch.fetched(left.withColumn("headers", F.lit(None))).collect()}
    assert bodies == {1500: BODY[1500:3000], 4500: BODY[4500:]}


def box(kind, payload=b""):
    return struct.pack(">I", 8 + len(payload)) + kind + payload


def init(*entries):
    """moov with a track for each (entry type, fixed bytes, tenc or none)."""
    out = b""
    for kind, head, tenc in entries:
        sinf = box(b"sinf", box(b"schm", bytes(4) + b"cbcs" + bytes(4)) + box(b"schi", tenc)) if tenc else b""
        out += box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1) + box(kind, head + sinf))))))
    return box(b"free", b"....tenc" + bytes(40)) + box(b"moov", out)


def test_tracks_of_an_init_segment(spark):
    a = box(b"tenc", bytes([1, 0, 0, 0, 0, 0x19, 1, 0]) + bytes(range(16)) + bytes([16]) + b"\x11" * 16)
    b = box(b"tenc", bytes([0, 0, 0, 0, 0, 0x19, 1, 8]) + bytes(range(16, 32)))
    short = box(b"tenc", bytes(12))
    version1 = bytes(8) + b"\0\1" + bytes(34)
    data = init((b"mp4a", bytes(28), None), (b"encv", bytes(78), a), (b"enca", version1, b), (b"encv", bytes(78), short))
    rows = binary.protection(spark.createDataFrame([("s", bytearray(data)), ("t", bytearray(b"x")), ("u", None)], "id string, data binary")).orderBy("track").collect()
    assert [(r.id, r.track, r.scheme, r.iv_size, r.crypt, r.skip) for r in rows] == [("s", 1, "cbcs", 0, 1, 9), ("s", 2, "cbcs", 8, 0, 0)]
    assert bytes(rows[0].constant_iv) == b"\x11" * 16 and rows[1].constant_iv is None and bytes(rows[1].kid) == bytes(range(16, 32))


def test_counters_run_on_over_batches(spark, tmp_path):
    """Three runs over more and more files, then one that finds nothing new; against counting at once."""
    rng = random.Random(5)
    rows = []
    for seg in range(6):
        for stream in ("a", "b"):
            packets = [(rng.choice([256, 257, 0x1FFF]), rng.choice([0, 1, 2, 3]), rng.randrange(16)) for _ in range(20)]
            rows.append((stream, seg, b"".join(bytes([0x47, pid >> 8, pid & 255, afc << 4 | cc]) + bytes(184) for pid, afc, cc in packets)))
    frame = spark.createDataFrame(rows, "stream string, segment long, data binary")
    out = sink.Counters(str(tmp_path / "cc"))
    for n in (0, 1, 2, 2):
        if not (tmp_path / f"in/part={n}").exists():
            frame.filter(f"segment DIV 2 = {n}").write.parquet(str(tmp_path / f"in/part={n}"))
        out.counting(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in/part=*")), availableNow=True).awaitTermination()
    seen = {(r.stream, r.segment): bytes(r.data) for r in out.read(frame).collect()}
    assert seen == {(r.stream, r.segment): bytes(r.data) for r in transport.continued(frame).collect()} and len(seen) == 12


def test_keys_are_fetched_once(spark, site):
    uris = [f"{site}/key16", f"{site}/key16", f"{site}/whole", f"{site}/gone", "data:;base64,MDEyMzQ1Njc4OWFiY2RlZg==", "data:,short", "", None]
    jar = spark.createDataFrame([("127.0.0.1", True, "/", False, 0, "b", "2"), ("127.0.0.1", True, "/key", False, 0, "a", "1"), ("127.0.0.1", True, "/", True, 0, "c", "3")], "domain string, subdomains boolean, path string, secure boolean, expires long, name string, value string")
    frame = spark.createDataFrame([(u,) for u in uris], "uri string")
    headers = pages.cookie_headers(frame.filter("uri LIKE 'http%'").withColumnRenamed("uri", "url"), jar)
    assert {r.url.rsplit("/", 1)[1]: r.headers["Cookie"] for r in headers.collect()} == {"key16": "a=1; b=2", "whole": "b=2", "gone": "b=2"}
    keys = pages.keys_by_uri(frame, headers, retries=1)
    got = {r.uri.removeprefix(site): (r.key and bytes(r.key), r.error) for r in keys.collect()}
    assert got == {
        "/key16": (BODY[:8] + b"a=1; b=2", None), "/whole": (None, "key of 5000 bytes"), "/gone": (None, "not fetched: status 404"),
        "data:;base64,MDEyMzQ1Njc4OWFiY2RlZg==": (b"0123456789abcdef", None), "data:,short": (None, "not a key of 16 bytes"),
    }
    assert Handler.seen["/key16"] == 1
    segments = spark.createDataFrame([(1, (f"{site}/gone",)), (2, None)], "id long, key struct<uri:string>")
    assert [(r.id, r.aes_key, r.key_error) for r in pages.with_keys(segments, keys).orderBy("id").collect()] == [(1, None, "not fetched: status 404"), (2, None, None)]
