from weirstream.operators import window

TRACK = "track_id string, ord long, media_type string, live boolean, ended boolean, fmp4 boolean, has_init boolean, bandwidth long, codecs string, width int, height int, frame_rate double, language string, name string, channels string, is_default boolean"


def track(spark, id="v", kind="video", live=True, ended=False, fmp4=True, bandwidth=0, codecs="avc1", ord=0, w=1280, h=720):
    return spark.createDataFrame([(id, ord, kind, live, ended, fmp4, True, bandwidth, codecs, w, h, 25.0, "", "", "", False)], TRACK)


def arrivals(spark, durations, id="v"):
    rows = [(id, i, float(d), False, 1000) for i, d in enumerate(durations)]
    return window.numbered(spark.createDataFrame(rows, "track_id string, arrival long, duration double, discontinuity boolean, n_bytes long"))


def body(frame):
    return frame.first().body


def test_fmp4_playlist(spark):
    text = body(window.media_playlists(arrivals(spark, [6] * 3), track(spark)))
    for part in ("#EXT-X-VERSION:6\n", "#EXT-X-TARGETDURATION:6\n", "#EXT-X-MEDIA-SEQUENCE:0\n", '#EXT-X-MAP:URI="init.mp4"\n', "#EXTINF:6.000,\n000000.m4s\n"):
        assert part in text
    assert "ENDLIST" not in text
    ts = body(window.media_playlists(arrivals(spark, [6] * 3), track(spark, fmp4=False)))
    assert "#EXT-X-VERSION:3\n" in ts and "MAP" not in ts and "000002.ts" in ts


def test_live_window_and_vod(spark):
    text = body(window.media_playlists(arrivals(spark, [6] * 16), track(spark)))
    assert text.count("#EXTINF") == 6 and "#EXT-X-MEDIA-SEQUENCE:10\n" in text
    vod = body(window.media_playlists(arrivals(spark, [6] * 16), track(spark, live=False, ended=True)))
    assert vod.count("#EXTINF") == 16 and vod.endswith("#EXT-X-ENDLIST\n")


def test_missing_durations(spark):
    rows = arrivals(spark, [0, 1, 0, 5, 0]).orderBy("seq").collect()
    assert [r.dur for r in rows] == [2.0, 1.0, 2.0, 5.0, 5.0]
    assert [r.start_ms for r in rows] == [0, 2000, 3000, 5000, 10000]


def test_master(spark):
    tracks = track(spark, bandwidth=5000000).union(track(spark, "a", "audio", bandwidth=128000, codecs="mp4a", ord=1))
    stats = window.track_stats(arrivals(spark, [4]).union(arrivals(spark, [4], "a")), tracks)
    text = body(window.master_playlist(stats))
    assert 'BANDWIDTH=5128000,CODECS="avc1,mp4a",RESOLUTION=1280x720,FRAME-RATE=25.000,AUDIO="aud"\nv/index.m3u8' in text
    assert '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="aud",NAME="a",DEFAULT=YES,AUTOSELECT=YES,URI="a/index.m3u8"' in text
    only = body(window.master_playlist(window.track_stats(arrivals(spark, [4], "a"), tracks.filter("track_id = 'a'"))))
    assert '#EXT-X-STREAM-INF:BANDWIDTH=128000,CODECS="mp4a"\na/index.m3u8' in only


def test_mpd(spark):
    text = body(window.dash_manifest(arrivals(spark, [4] * 4), track(spark, live=False), "S", "N"))
    assert 'type="static"' in text and 'mediaPresentationDuration="PT16.000S"' in text and '<S t="0" d="4000" r="3"/>' in text
    live = body(window.dash_manifest(arrivals(spark, [4] * 9), track(spark), "S", "N"))
    for part in ('startNumber="3"', '<S t="12000" d="4000"', 'minimumUpdatePeriod="PT4S"', 'timeShiftBufferDepth="PT24S"', 'suggestedPresentationDelay="PT12S"', 'minBufferTime="PT4.0S"'):
        assert part in live
    mixed = body(window.dash_manifest(arrivals(spark, [4, 4, 2]), track(spark, live=False), "S", "N"))
    assert 'd="4000" r="1"' in mixed and '<S t="8000" d="2000"/>' in mixed
