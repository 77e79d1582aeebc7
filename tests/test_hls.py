from weirstream.sources import hls

MASTER = """#EXTM3U
# a catalog of three qualities
#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="sound",NAME="Suomi",LANGUAGE="fi",DEFAULT=NO,CHANNELS="6",URI="fi/list.m3u8"
#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="sound",NAME="in the video",LANGUAGE="sv"
#EXT-X-MEDIA:TYPE=SUBTITLES,GROUP-ID="text",NAME="Norsk",LANGUAGE="no",URI="no/text.m3u8"
#EXT-X-STREAM-INF:BANDWIDTH=640000,RESOLUTION=640x360,FRAME-RATE=24,CODECS="hvc1.1.6.L93,ec-3",AUDIO="sound",SUBTITLES="text"
low/list.m3u8?a=1
#EXT-X-STREAM-INF:BANDWIDTH=5100000,AVERAGE-BANDWIDTH=4300000,RESOLUTION=2560x1440
/top/list.m3u8
"""
MEDIA = """#EXTM3U
#EXT-X-TARGETDURATION:9
#EXT-X-MEDIA-SEQUENCE:41
#EXT-X-MAP:URI="head.mp4",BYTERANGE="64@16"
#EXT-X-KEY:METHOD=AES-128,URI="keys/7",IV=0x000102030405060708090A0B0C0D0E0F
#EXTINF:8.5,first
p41.m4s
#EXTINF:8.25,
p42.m4s
#EXT-X-KEY:METHOD=NONE
#EXT-X-DISCONTINUITY
#EXTINF:3,
p43.m4s
"""


def playlists(spark, **bodies):
    return spark.createDataFrame([(k, "https://stage.example.org/vault/catalog.m3u8", v) for k, v in bodies.items()], "manifest_id string, url string, body string")


def test_master(spark):
    rows = {r.id: r for r in hls.parse_masters(playlists(spark, m=MASTER)).collect()}
    assert sorted(rows) == ["a1", "s1", "v1", "v2"]
    low, top, sound, text = rows["v1"], rows["v2"], rows["a1"], rows["s1"]
    assert (low.bandwidth, low.audio_group, low.subs_group, low.playlist_url) == (640000, "sound", "text", "https://stage.example.org/vault/low/list.m3u8?a=1")
    assert (low.width, low.height, low.frame_rate, low.muxed_audio, low.media_type) == (640, 360, 24.0, True, "video")
    assert (top.bandwidth, top.playlist_url, top.muxed_audio) == (4300000, "https://stage.example.org/top/list.m3u8", False)
    assert (sound.language, sound.is_default, sound.channels, sound.group_id) == ("fi", False, "6", "sound") and text.playlist_url == "https://stage.example.org/vault/no/text.m3u8"


def test_a_media_playlist_is_a_catalog_of_one(spark):
    rows = hls.parse_masters(playlists(spark, m=MEDIA)).collect()
    assert [(r.id, r.media_type, r.playlist_url, r.bandwidth) for r in rows] == [("v1", "video", "https://stage.example.org/vault/catalog.m3u8", 0)]


def test_unpaired_variant_uses_a_number(spark):
    body = '#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=1\n#EXT-X-STREAM-INF:BANDWIDTH=2,CODECS="mp4a.40.2"\na.m3u8\nb.m3u8\n'
    assert [(r.id, r.bandwidth, r.media_type) for r in hls.parse_masters(playlists(spark, m=body)).collect()] == [("v2", 2, "audio")]


def test_media(spark):
    rows = hls.parse_media(playlists(spark, s=MEDIA)).orderBy("seg_ord").collect()
    assert [(r.seq, r.duration, r.discontinuity) for r in rows] == [(41, 8.5, False), (42, 8.25, False), (43, 3.0, True)]
    assert rows[1].key.method == "AES-128" and bytes(rows[1].key.iv) == bytes(range(16)) and rows[1].key.uri == "https://stage.example.org/vault/keys/7" and rows[2].key is None
    assert rows[2].init.url == "https://stage.example.org/vault/head.mp4" and (rows[2].init.range.start, rows[2].init.range.end) == (16, 79)
    info = hls.media_info(playlists(spark, s=MEDIA)).first()
    assert (info.live, info.media_seq, info.target_dur, info.refresh_s) == (True, 41, 9.0, 4.5)
    assert not hls.media_info(playlists(spark, s=MEDIA + "#EXT-X-ENDLIST\n")).first().live


def test_a_bad_iv_rejects_the_playlist(spark):
    both = playlists(spark, good=MEDIA, bad=MEDIA.replace("0x0001", "0xZZ01"))
    assert {r.stream_id for r in hls.parse_media(both).collect()} == {"good"}
    assert [(r.manifest_id, r.reason[:8]) for r in hls.rejected(both).collect()] == [("bad", "bad IV Z")]


def test_tag_lines_are_read_whole(spark):
    body = '#EXTM3U\n#EXT-X-KEY:METHOD=AES-128,URI="data:' + "A" * (1 << 20) + '",IV=0x0f\n#EXTINF:1,\na.ts\n'
    row = hls.parse_media(playlists(spark, s=body)).first()
    assert len(row.key.uri) == (1 << 20) + 5 and bytes(row.key.iv) == b"\x0f"


def test_byte_ranges_chain(spark):
    body = "#EXTM3U\n#EXTINF:1,\n#EXT-X-BYTERANGE:1000@0\na.ts\n#EXTINF:1,\n#EXT-X-BYTERANGE:2000\na.ts\n#EXTINF:1,\nb.ts\n#EXTINF:1,\n#EXT-X-BYTERANGE:10\nc.ts\n"
    rows = hls.parse_media(playlists(spark, s=body)).orderBy("seg_ord").collect()
    assert [r.range and (r.range.start, r.range.end) for r in rows] == [(0, 999), (1000, 2999), None, (0, 9)]


def test_drm_key(spark):
    body = '#EXTM3U\n#EXT-X-KEY:METHOD=SAMPLE-AES,URI="skd://x"\n#EXTINF:1,\na.ts\n'
    assert hls.parse_media(playlists(spark, s=body)).first().key.method == "CENC"


def test_attributes(spark):
    row = spark.createDataFrame([('a=1,B="x,y",a=2,C="open',)], "t string").select(hls.attributes(__import__("pyspark").sql.functions.col("t")).alias("m")).first()
    assert row.m == {"A": "2", "B": "x,y", "C": "open"}


def test_sniff(spark):
    from pyspark.sql import functions as F

    from weirstream.sources import dash

    rows = spark.createDataFrame([(MASTER,), ("<?xml?><MPD/>",), ("no",)], "b string").select(hls.is_hls(F.col("b")).alias("h"), dash.is_dash(F.col("b")).alias("d")).collect()
    assert [(r.h, r.d) for r in rows] == [(True, False), (False, True), (False, False)]
