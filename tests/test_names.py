import base64

from pyspark.sql import functions as F

from weirstream.functions import names
from weirstream.sources import pages, subtitles


def test_track_ids(spark):
    rows = [("m", 0, "video", ""), ("m", 1, "video", "en"), ("m", 2, "audio", "fr"), ("m", 3, "audio", "fr"), ("m", 4, "subtitles", "pt BR"), ("n", 0, "audio", "")]
    got = names.track_ids(spark.createDataFrame(rows, "manifest_id string, ord int, media_type string, language string")).orderBy("manifest_id", "ord").collect()
    assert [r.track_id for r in got] == ["video", "video2", "audio-fr", "audio-fr2", "sub-pt_BR", "audio"]


def test_paths(spark):
    rows = [("", "https://h/a/show.m3u8?x=1", False), ("", "https://h/", True), ("mine", "u", False), ("x/my.mkv", "u", False)]
    got = spark.createDataFrame(rows, "out string, url string, live boolean").select(names.output_path(F.col("out"), F.col("url"), F.col("live"), F.lit("T")).alias("p")).collect()
    assert [r.p for r in got] == ["show.mp4", "stream-output-T.mp4", "mine.mp4", "x/my.mkv"]
    subs = spark.createDataFrame([("d/out.mp4", "s1", 0, "en", "English"), ("d/out.mp4", "s2", 1, "en", "forced"), ("v.mp4", "s3", 0, "", "")], "out string, id string, ord int, language string, name string")
    assert sorted(r.path for r in names.sidecars(subs).collect()) == ["d/out.en.forced.srt", "d/out.en.srt", "v.sub.srt"]
    one = spark.range(1).select(
        names.raw_extension(F.lit("video"), F.lit("a.m4s"), F.lit(False)).alias("a"), names.raw_extension(F.lit("video"), F.lit("a.ts"), F.lit(False)).alias("b"), names.subtitle_codec(F.lit(".mkv")).alias("c"),
        names.segment_mime(F.lit("x.ts")).alias("d"), names.refresh_seconds(F.lit(6.0), F.lit(0.0), F.lit(0.0)).alias("e"), names.refresh_seconds(F.lit(0.0), F.lit(0.0), F.lit(3.0)).alias("f"),
    ).first()
    assert tuple(one) == (".mp4", ".ts", "srt", "video/mp2t", 3.0, 2.0)


def test_data_keys(spark):
    key = bytes(range(16))
    rows = [("data:text/plain;base64," + base64.b64encode(key).decode(),), ("data:,0123456789abcdef",), ("data:,short",), ("https://x/k",)]
    got = {r.uri: r.key and bytes(r.key) for r in pages.data_uri_keys(spark.createDataFrame(rows, "uri string")).collect()}
    assert got == {rows[0][0]: key, rows[1][0]: b"0123456789abcdef", rows[2][0]: None}
    segs = spark.createDataFrame([("s", (rows[1][0],)), ("t", None)], "stream_id string, key struct<uri:string>")
    assert {r.stream_id: bool(r.aes_key) for r in pages.with_keys(segs, pages.data_uri_keys(spark.createDataFrame(rows, "uri string"))).collect()} == {"s": True, "t": False}


def test_converted_files(spark):
    ttml = b'<tt><p begin="1s" end="2s">boxed</p></tt>'
    mp4 = b"\0\0\0\x08ftyp" + (8 + len(ttml)).to_bytes(4, "big") + b"mdat" + ttml
    rows = [(1, "a", bytearray(b"WEBVTT\n\n02:00:00.000 --> 02:00:01.000\nhi\n")), (2, "b", bytearray(mp4)), (3, "c", bytearray(b"nothing"))]
    got = {r.track_id: r.body for r in subtitles.converted(spark.createDataFrame(rows, "id long, track_id string, data binary")).collect()}
    assert got == {"a": "1\n00:00:00,000 --> 00:00:01,000\nhi\n\n", "b": "1\n00:00:01,000 --> 00:00:02,000\nboxed\n\n"}
