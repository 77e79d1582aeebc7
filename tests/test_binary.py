import struct

from pyspark.sql import functions as F

from weirstream.functions import binary, scalars, urls
from weirstream.sources import fetch, pages


def box(kind, payload=b""):
    return struct.pack(">I", 8 + len(payload)) + kind + payload


def test_boxes(spark):
    data = box(b"moov", box(b"trak", box(b"abcd", b"12"))) + box(b"mdat", b"one") + struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 19) + b"two" + struct.pack(">I", 0) + b"mdat" + b"end"
    frame = spark.createDataFrame([(1, bytearray(data))], "id long, data binary")
    assert [r.path for r in binary.boxes(frame).orderBy("at").collect()] == ["/moov", "/moov/trak", "/moov/trak/abcd", "/mdat", "/mdat", "/mdat"]
    assert bytes(binary.media_data(frame).first().body) == b"onetwoend"


def test_image_prefix(spark):
    packet = b"\x47" + bytes(187)
    rows = [bytearray(b"\x89PNG1234567" + packet * 3), bytearray(b"GIF8" + b"\0\0\0\x08moof"), bytearray(packet), None]
    got = [r.d and bytes(r.d) for r in spark.createDataFrame([(r,) for r in rows], "d binary").select(binary.without_image_header("d").alias("d")).collect()]
    assert got == [packet * 3, b"\0\0\0\x08moof", packet, None]


def test_cbc_with_and_without_padding(spark):
    frame = spark.createDataFrame([(bytearray(b"0123456789abcdef"), bytearray(b"sixteen bytes ok, and some more!"))], "k binary, p binary")
    iv = binary.sequence_iv(F.lit(258))
    sealed = F.aes_encrypt("p", "k", F.lit("CBC"), F.lit("PKCS"), iv)
    body = F.substr(sealed, F.lit(17), F.octet_length(sealed))
    r = frame.select(iv.alias("iv"), binary.segment_decrypt(body, F.col("k"), F.lit(None).cast("binary"), F.lit(258)).alias("a"), binary.cbc_decrypt(F.substr(body, F.lit(1), F.lit(32)), F.col("k"), iv).alias("b")).first()
    assert bytes(r.iv) == bytes(14) + b"\1\2" and bytes(r.a) == b"sixteen bytes ok, and some more!" == bytes(r.b)


def test_ctr_against_a_known_answer(spark):
    """NIST SP 800-38A, F.5.1."""
    key, iv = "2b7e151628aed2a6abf7158809cf4f3c", "f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff"
    plain = "6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51"
    want = "874d6191b620e3261bef6864990db6ce9806f66b7970fdff8617187bb9fffdff"
    r = spark.range(1).select(binary.ctr_decrypt(F.unhex(F.lit(plain)), F.unhex(F.lit(key)), F.unhex(F.lit(iv))).alias("c")).first()
    assert bytes(r.c).hex() == want


def test_continuity(spark):
    rows = [("s", 0, i, 256, 1, 9) for i in range(3)] + [("s", 1, i, 256, 3, 0) for i in range(3, 20)] + [("s", 1, 20, 0x1FFF, 1, 7), ("s", 1, 21, 256, 2, 5)]
    got = [r.out_cc for r in binary.continuity(spark.createDataFrame(rows, "stream string, segment long, pkt_no long, pid int, afc int, cc int")).orderBy("pkt_no").collect()]
    assert got == [i % 16 for i in range(20)] + [7, 5]


def test_urls_keys_cookies(spark):
    frame = spark.createDataFrame([("https://a.b/c/d.m3u8?x", "../e.ts"), ("https://a.b/c", "//h/i"), (None, "x")], "b string, r string")
    assert [r.u for r in frame.select(urls.resolve("b", "r").alias("u")).collect()] == ["https://a.b/e.ts", "https://h/i", None]
    specs = spark.createDataFrame([("00112233-4455-6677-8899-aabbccddeeff:" + "1" * 32,), ("2" * 32,), ("short",)], "spec string")
    keys = pages.keys(specs)
    assert sorted(bytes(r.kid).hex() for r in keys.collect()) == ["0" * 32, "00112233445566778899aabbccddeeff"]
    wanted = spark.createDataFrame([("s", bytearray(bytes.fromhex("00112233445566778899aabbccddeeff")), None), ("t", bytearray(16), None)], "stream_id string, tenc_kid binary, manifest_kid binary")
    assert {r.stream_id: bytes(r.key).hex()[0] for r in pages.resolve_keys(wanted, keys).collect()} == {"s": "1", "t": "2"}
    jar = pages.cookies(spark.createDataFrame([(".ex.com\tTRUE\t/\tTRUE\t0\ta\t1",), ("#HttpOnly_www.ex.com\tFALSE\t/p\tFALSE\t9\tb\t2",), ("# comment",), ("x",)], "line string"))
    sent = pages.cookies_for(spark.createDataFrame([("https://www.ex.com/p/q",), ("http://www.ex.com/",)], "url string"), jar)
    assert sorted((r.url, r.name) for r in sent.collect()) == [("https://www.ex.com/p/q", "a"), ("https://www.ex.com/p/q", "b")]


def test_links(spark):
    html = """<a href="x/a.m3u8?t=1"> "https:\\/\\/h/b.mpd" 'https://h/c.m3u8' src='x/a.m3u8?t=1'"""
    rows = pages.page_links(spark.createDataFrame([(1, "https://h/p/", html)], "page_id long, url string, html string")).orderBy("place").collect()
    assert [r.link for r in rows] == ["https://h/b.mpd", "https://h/c.m3u8", "https://h/p/x/a.m3u8?t=1"]


def test_fetch_reads_files(spark, tmp_path):
    (tmp_path / "f.txt").write_bytes(b"hello")
    fetch.register(spark)
    rows = {r.url: r for r in spark.read.format("fetch").option("urls", f"{tmp_path}/f.txt\n{tmp_path}/none").load().collect()}
    assert bytes(rows[f"{tmp_path}/f.txt"].body) == b"hello" and rows[f"{tmp_path}/none"].error


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(scalars.frame_rate(F.lit("30000/1001"))) == 30000 / 1001 and get(scalars.frame_rate(F.lit("25"))) == 25 and get(scalars.frame_rate(F.lit("x/0"))) == 0
    assert get(scalars.bytes_text(F.lit(1536))) == "1.5 KB" and get(scalars.bytes_text(F.lit(12))) == "12 B"
    assert get(scalars.language3(F.lit("en-US"))) == "eng" and get(scalars.language3(F.lit("xx"))) == "xx" and get(scalars.language3(F.lit("FRA"))) == "fra" and get(scalars.language3(F.lit(""))) == ""
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert [get(scalars.retry_after(F.lit(t), now)) for t in ("5", "", "-3", "Mon, 01 Jan 2024 00:00:07 GMT")] == [5, 0, 0, 7]
    assert get(scalars.range_header(F.struct(F.lit(30).alias("start"), F.lit(-1).alias("end")))) == "bytes=30-"
    assert get(scalars.safe_name(F.lit("a b/ç.ts"))) == "a_b_.ts"


def test_key_ids_of_suppliers_and_nations_are_apart(spark, tmp_path):
    from hashlib import md5

    from weirstream import queries

    spark.createDataFrame([(1000, 3), (1002, 3), (1001, 2)], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(5).select(F.col("id").alias("n_nationkey")).write.parquet(f"{tmp_path}/nation.parquet")
    got = sorted((r.stream_id, r.key_hex) for r in queries.key_resolve(spark, str(tmp_path)).collect())
    twice = lambda n: md5(md5(n).digest()).hexdigest()
    assert got == [(1000, None), (1001, twice(b"2")), (1002, twice(b"1002"))]


def test_repeated_key_ids_repeat_no_stream(spark):
    wanted = spark.createDataFrame([("s", bytearray(b"k"), None)], "stream_id string, tenc_kid binary, manifest_kid binary")
    known = spark.createDataFrame([(bytearray(b"k"), bytearray(b"2")), (bytearray(b"k"), bytearray(b"1"))], "kid binary, key binary")
    assert [bytes(r.key) for r in pages.resolve_keys(wanted, known).collect()] == [b"1"]


def test_xor_of_arrow_arrays():
    import pyarrow as pa

    a = pa.array([b"skipped", b"ab", None, b"", b"\xff\x00\x01", b"z"], pa.binary())
    b = pa.array([b"skipped", b"\x01\x02\x03", b"x", b"", b"\x0f\x0f\x0f", None], pa.binary())
    want = [b"``", None, b"", b"\xf0\x0f\x0e", None]
    xor = binary.xor_bytes.func
    assert xor(a.slice(1), b.slice(1)).to_pylist() == want == xor(a.slice(1).cast(pa.large_binary()), b.slice(1)).to_pylist()
    assert xor(a.slice(0, 0), b.slice(0, 0)).to_pylist() == [] and xor(pa.nulls(2, pa.binary()), b.slice(0, 2)).to_pylist() == [None, None]


def test_rows_are_worked_on_one_at_a_time():
    import pyarrow as pa

    column = pa.array([b"skipped", b"ab", None, b"", b"odd", b"abc"], pa.binary()).slice(1)
    other = pa.array([b"1", b"2", b"3", b"4", None], pa.binary())
    got = binary.by_row(lambda a, b: None if b == b"4" else a + b, column, other)
    assert got.to_pylist() == [b"ab1", None, b"3", None, None] and got.type == pa.binary()
    assert binary.by_row(lambda a: a, column.slice(0, 0)).to_pylist() == []
    bare = binary.without_image_header.func
    assert bare(column) is column  # no header, no copy
    segment = b"G" + b"x" * 187 + b"G" + b"y" * 187 + b"G" + b"z" * 187
    assert bare(pa.array([None, b"GIF8..." + segment, segment, b"BM"])).to_pylist() == [None, segment, segment, b"BM"]
