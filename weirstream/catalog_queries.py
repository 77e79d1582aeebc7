"""Queries over sources, names, requests and bytes: bodies are written from the driver's tables and read again."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views
from .functions import binary, names, scalars
from .operators import status
from .plans import segments, select
from .sources import dash, fetch, hls, pages, resolver, subtitles
from .streaming import sink
from .views import table, with_views


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))


K = F.col


def hls_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Master playlists of the catalog, written out and parsed."""
    s = views.streams(spark, sf_dir)
    given = lambda name, c: F.when(K(c) != "", _text(f',{name}="', K(c), '"')).otherwise(F.lit(""))
    video = _text("#EXT-X-STREAM-INF:BANDWIDTH=", K("bandwidth"), ",RESOLUTION=", K("width"), "x", K("height"), ',CODECS="avc1.64', F.when(K("muxed_audio"), F.lit(",mp4a.40.2")).otherwise(F.lit("")), '"', given("AUDIO", "audio_group"), given("SUBTITLES", "subs_group"), "\nv/", K("id"), ".m3u8\n")
    kind = F.when(K("media_type") == "audio", F.lit("AUDIO")).otherwise(F.lit("SUBTITLES"))
    rendition = _text("#EXT-X-MEDIA:TYPE=", kind, ',GROUP-ID="', K("group_id"), '",NAME="', K("name"), ', etc",LANGUAGE="', K("language"), '",URI="r/', K("id"), '.m3u8"\n')
    line = F.when(K("media_type") == "video", video).otherwise(rendition)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "")
    rows = hls.parse_masters(s.groupBy("manifest_id").agg(F.concat(F.lit("#EXTM3U\n"), body).alias("body")).withColumn("url", F.lit("https://ex.com/hls/main.m3u8")))
    return rows.select("manifest_id", "id", "ord", "media_type", "playlist_url", "bandwidth", "width", "height", "language", "audio_group", "group_id", "muxed_audio")


def hls_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and init maps in force for each segment of playlists that change them now and then."""
    e = K("event_id")
    key = F.when(e % 24 == 0, F.lit("#EXT-X-KEY:METHOD=NONE\n")).when(e % 24 == 6, _text('#EXT-X-KEY:METHOD=AES-128,URI="k/', e, '.bin",IV=0x', F.lpad(F.hex(e), 32, "0"), "\n"))
    key = key.when(e % 24 == 12, F.lit('#EXT-X-KEY:METHOD=SAMPLE-AES,URI="skd://x"\n')).when(e % 24 == 18, _text('#EXT-X-KEY:METHOD=AES-128,URI="data:,', e, '"\n')).otherwise(F.lit(""))
    init = F.when(e % 10 == 0, _text('#EXT-X-MAP:URI="i', e, '.mp4"\n')).otherwise(F.lit(""))
    lines = _text(key, init, "#EXTINF:2,\n", e, ".ts\n")
    b = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("manifest_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", lines.alias("l")))), lambda x: x["l"]), "").alias("b"))
    rows = hls.parse_media(b.select("manifest_id", F.lit("https://ex.com/a/b.m3u8").alias("url"), F.concat(F.lit("#EXTM3U\n"), "b").alias("body")))
    return rows.select("stream_id", "seg_ord", K("key.method").alias("method"), K("key.uri").alias("key_uri"), F.lower(F.hex("key.iv")).alias("iv"), K("init.url").alias("init_url"))


def hls_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import window

    win, tracks = window.numbered(views.arrivals(spark, sf_dir)), views.tracks(spark, sf_dir)
    bodies = window.media_playlists(win, tracks).select(F.col("track_id").alias("manifest_id"), F.lit("https://ex.com/t/index.m3u8").alias("url"), "body")
    return hls.media_info(bodies)


def _mpds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = K("k")
    body = _text(
        '<?xml version="1.0"?><MPD mediaPresentationDuration="PT', 20 + k % 7, 'S"><Period><AdaptationSet mimeType="video/mp4" frameRate="30000/1001"><SegmentTemplate timescale="10" duration="', 10 * (k % 5 + 2),
        '" media="v$RepresentationID$-$Number%03d$.mp4" startNumber="', k, '"/><Representation id="r', k, '" bandwidth="', k * 1000, '" width="640" height="360" codecs="avc1"/></AdaptationSet>',
        '<AdaptationSet mimeType="audio/mp4" lang="fi"><Representation id="a" bandwidth="64000" codecs="opus"><BaseURL>a/f.mp4</BaseURL><SegmentList timescale="10" duration="40"><Initialization range="0-', k,
        '"/><SegmentURL mediaRange="', k + 1, "-", k + 10, '"/><SegmentURL mediaRange="', k + 11, "-", k + 30, '"/></SegmentList></Representation></AdaptationSet>',
        '<AdaptationSet mimeType="application/ttml+xml" lang="de"><Representation id="t', k, '"><BaseURL>subs.ttml</BaseURL></Representation></AdaptationSet></Period></MPD>',
    )
    return _suppliers(spark, sf_dir).select(k.alias("manifest_id"), F.lit("https://ex.com/d/main.mpd").alias("url"), body.alias("body"))


def _dash(pattern: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = dash.parse_segments(_mpds(spark, sf_dir)).filter(K("stream_id").rlike(pattern))
        return rows.select("manifest_id", "stream_id", "seg_ord", "seq", "url", "duration", K("range.start").alias("first_byte"), K("range.end").alias("last_byte"), K("init.range.end").alias("init_end"))

    return query


def dash_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dash.streams(_mpds(spark, sf_dir))
    return rows.select("manifest_id", "id", "ord", "media_type", "bandwidth", "width", F.round("frame_rate", 2).alias("frame_rate"), "language", "n_segs", "dur_s")


def dash_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selector language over manifests of the other kind."""
    return select.select_streams(dash.streams(_mpds(spark, sf_dir)), video="segsmin=5:for=best").select("manifest_id", "pick", "id", "media_type")


def dash_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = K("k")
    body = _text('<MPD type="dynamic" availabilityStartTime="2024-01-01T00:00:00Z" timeShiftBufferDepth="PT20S"><Period start="PT0S"><AdaptationSet mimeType="video/mp4"><SegmentTemplate duration="', k % 5 + 2, '" media="$Number$" startNumber="', k, '"/><Representation id="v"/></AdaptationSet></Period></MPD>')
    rows = _suppliers(spark, sf_dir).select(k.alias("manifest_id"), F.lit("https://ex.com/d/live.mpd").alias("url"), body.alias("body"))
    return dash.parse_segments(rows, "2024-01-01 00:10:00+00:00").select("manifest_id", "seg_ord", "seq", "url")


def dash_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A show of three chapters: a track that goes on, one whose picture changes and one that comes in the last only."""
    k = K("k")
    chapter = lambda n, size, more: ('<Period id="c', n, '" duration="PT', k % 3 + 4, 'S"><AdaptationSet contentType="video"><Representation id="film" codecs="av01" width="', size, '" height="', size, '"><SegmentList timescale="1" duration="', k % 3 + 4, '"><SegmentURL media="reel/', n, '/', k, '.mp4"/></SegmentList></Representation></AdaptationSet>', more, "</Period>")
    late = '<AdaptationSet contentType="audio"><Representation id="talk"><BaseURL>talk.mp3</BaseURL></Representation></AdaptationSet>'
    body = _text("<MPD>", *chapter("a", F.lit(300), ""), *chapter("b", F.when(k % 2 == 0, 300).otherwise(900), ""), *chapter("c", F.lit(300), late), "</MPD>")
    rows = _suppliers(spark, sf_dir).select(k.alias("manifest_id"), F.lit("https://ex.com/cinema/show/").alias("url"), body.alias("body"))
    return dash.parse_segments(rows).select("manifest_id", "stream_id", "seg_ord", "seq", "url", "discontinuity")


def _bodies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A master playlist, a manifest, a page with a link and a page with a frame in turn; and what can be fetched."""
    k = K("k")
    s = _suppliers(spark, sf_dir)
    master = _text("#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=", k + 1, "\nx.m3u8\n")
    link, frame = _text('<video><source src="/m/', k, '.m3u8"></video>'), _text('<p>none here</p><iframe width="9" src="f/', k, '.html"></iframe>')
    mpds = _mpds(spark, sf_dir).select(F.col("manifest_id").alias("k"), F.col("body").alias("mpd"))
    body = F.when(k % 4 == 0, master).when(k % 4 == 1, K("mpd")).when(k % 4 == 2, link).otherwise(frame)
    rows = s.join(mpds, "k").select(k.alias("manifest_id"), F.lit("https://ex.com/w/page").alias("url"), body.alias("body"))
    media = s.select(_text("https://ex.com/m/", k, ".m3u8").alias("url"), F.lit("#EXTM3U\n#EXTINF:2,\na.ts\n").alias("body"))
    frames = s.select(_text("https://ex.com/w/f/", k, ".html").alias("url"), _text('<a href="../../m/', k, '.m3u8">').alias("body"))
    return rows, media.union(frames)


def manifest_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolver.catalog(*_bodies(spark, sf_dir)).select("manifest_id", "id", "media_type", "playlist_url", "bandwidth")


def manifest_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fetched = _bodies(spark, sf_dir)
    every = rows.select("url", "body").union(fetched).union(_suppliers(spark, sf_dir).select(_text("/data/", K("k"), ".m3u8"), F.lit("﻿ #EXTM3U")))
    kinds = every.select("url", resolver.kind_of(K("body")).alias("kind"), resolver.is_local(K("url")).alias("is_local"), resolver.base_of(K("url")).alias("base"))
    return kinds.groupBy("kind", "is_local").agg(F.count(F.lit(1)).alias("n"), F.max("base").alias("last_base"))


def refresh_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of a manifest matched by id in its next version; every third has lost its track."""
    k = K("manifest_id")
    known = dash.streams(_mpds(spark, sf_dir)).filter("media_type = 'video'").select("manifest_id", "id")
    changed = _mpds(spark, sf_dir).withColumn("body", F.when(k % 3 == 0, F.replace(K("body"), F.lit('<Representation id="r'), F.lit('<Representation id="q'))).otherwise(K("body")))
    return resolver.refreshed(known, changed).groupBy("manifest_id", "id", "lost").agg(F.count("url").alias("n"))


def _marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = K("page_id")
    more = _text('<script>var u="https:\\/\\/cdn.ex.com\\/', i, '\\/live.mpd?x=1&y", v = "http://ex.net/a.m3u8.bak"</script><video data-src=\'v/', i, '.m3u8\' src="https://cdn.ex.com/', i, '/live.mpd?x=1&y"></video>')
    return table(spark, sf_dir, "pages").select("page_id", F.lit("https://site.ex/dir/page").alias("url"), F.concat("html", F.when(i % 5 != 0, more).otherwise(F.lit(""))).alias("html"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _marked_pages(spark, sf_dir).select("page_id", pages.links(F.col("html")).alias("links"))
    return rows.select("page_id", F.size("links").cast("long").alias("n_links"), F.array_join("links", " ").alias("links"))


def page_links_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_links(_marked_pages(spark, sf_dir)).select("page_id", F.col("place").cast("int").alias("place"), "link")


def cookie_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = K("n_nationkey")
    line = _text(F.when(n % 2 == 0, F.lit("#HttpOnly_.")).otherwise(F.lit("")), "Ex", n, ".com\tTRUE\t/", F.when(n % 3 == 0, F.lit("a")).otherwise(F.lit("")), "\t", F.when(n % 5 == 0, F.lit("TRUE")).otherwise(F.lit("FALSE")), "\t", n, "\tc", n, "\tv", n)
    lines = table(spark, sf_dir, "nation").select(line.alias("line")).union(spark.createDataFrame([("# a comment\t1\t2\t3\t4\t5\t6",), ("",), ("too\tfew",)], "line string"))
    urls = _suppliers(spark, sf_dir).select(_text(F.when(K("k") % 2 == 0, F.lit("http")).otherwise(F.lit("https")), "://w.ex", K("n"), ".com/", F.when(K("k") % 4 < 2, F.lit("a/")).otherwise(F.lit("b/")), K("k")).alias("url"))
    return pages.cookies_for(urls, pages.cookies(lines))


def key_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, h = K("k"), F.md5(K("k").cast("string").cast("binary"))
    kid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    spec = F.when(k % 4 == 0, F.concat(kid, F.lit(":"), F.reverse(h))).when(k % 4 == 1, F.concat(h, F.lit(":"), F.upper(h))).when(k % 4 == 2, h).otherwise(F.concat(h, F.lit(":12")))
    return pages.keys(_suppliers(spark, sf_dir).select(spec.alias("spec"))).select(F.lower(F.hex("kid")).alias("kid"), F.lower(F.hex("key")).alias("key"))


def data_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, h = K("k"), F.md5(K("k").cast("string").cast("binary"))
    uri = F.when(k % 3 == 0, F.concat(F.lit("data:text/plain;base64,"), F.base64(F.unhex(h)))).when(k % 3 == 1, F.concat(F.lit("data:,"), F.substring(h, 1, 16))).otherwise(F.concat(F.lit("data:,"), h))
    return pages.data_uri_keys(_suppliers(spark, sf_dir).select(uri.alias("uri"))).select("uri", F.lower(F.hex("key")).alias("key"))


def subtitle_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of six kinds around each part's own name, some behind blanks or an XML head."""
    k, name = K("p_partkey"), K("p_name")
    body = F.when(k % 6 == 0, _text(F.repeat(F.lit(" "), (k % 5).cast("int")), "WEBVTT ", name, "\n\n")).when(k % 6 == 1, _text("<?xml version='1.0'?>\n<!-- ", name, " -->"))
    body = body.when(k % 6 == 2, _text("<!--", k, "--><tt:tt id='", name, "'>")).when(k % 6 == 3, _text(k, "\n00:00:0", k % 10, ",000 --> 00:01:00,000\n", name)).when(k % 6 == 4, _text("abcdmoof", name, k))
    return table(spark, sf_dir, "part").select(k.alias("k"), subtitles.sniff(body.otherwise(_text(name, " --> ", k))).alias("kind"))


def ttml_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per user; in every third one paragraphs give their end first."""
    begin, end = lambda e: _text('begin="', e, '.5s"'), lambda e: _text('end="', (e + 2) * 20, 't"')
    times = lambda e: F.when(K("user_id") % 3 == 0, F.concat_ws(" ", end(e), begin(e))).otherwise(F.concat_ws(" ", begin(e), end(e)))
    p = lambda x: _text("<p id='", x["event_id"], "' ", times(x["event_id"]), "><span>", x["event_type"], "</span><br />&amp; ", x["event_id"], "</p>")
    events = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    files = table(spark, sf_dir, "events").groupBy("user_id").agg(events.alias("e"))
    files = files.select(K("user_id").alias("track_id"), F.concat(F.lit('<tt ttp:tickRate="20">'), F.array_join(F.transform("e", p), "\n"), F.lit("</tt>")).alias("body"))
    return subtitles.parse_ttml(files).select("track_id", "cue_ord", "start", "end", "text")


def resume_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = K("k")
    state = F.when(k % 5 == 4, F.lit("{broken")).otherwise(_text('{"next_idx":', k, ',"offset":', k * 10, "}"))
    return segments.resume_points(_suppliers(spark, sf_dir).select(k.alias("stream_id"), state.alias("state"), (k * 10 + k % 3 - 1).alias("file_bytes")))


def track_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.track_ids(views.streams(spark, sf_dir)).select("manifest_id", "id", "track_id")


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = K("k")
    out = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, _text("clip", k)).otherwise(_text("clip", k, ".mkv"))
    url = _text("https://ex.com/a/show-", k, ".m3u8?t=", k)
    rows = _suppliers(spark, sf_dir).select(
        "k", names.output_path(out, url, k % 2 == 0, F.lit("20240102")).alias("path"), names.raw_extension(F.when(k % 4 == 0, F.lit("subtitles")).otherwise(F.lit("video")), _text("s", k, F.when(k % 5 == 0, F.lit(".m4s")).otherwise(F.lit(".ts"))), F.lit(False)).alias("raw"),
        names.segment_mime(_text("x", F.when(k % 2 == 0, F.lit(".ts")).otherwise(F.lit(".m4s")))).alias("mime"), names.display_name(F.when(k % 2 == 0, F.lit("")).otherwise(_text("N", k)), F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("fi")), _text("t", k)).alias("shown"),
        names.stream_format(F.when(k % 2 == 0, F.lit(" DASH")).otherwise(F.lit(""))).alias("format"),
    )
    return rows.withColumn("codec", names.subtitle_codec(F.regexp_extract("path", r"(\.[a-z0-9]+)$", 1)))


def sidecar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.streams(spark, sf_dir).filter("media_type = 'subtitles'").select(F.concat("manifest_id", F.lit(".mp4")).alias("out"), "id", "ord", "language", F.lit("").alias("name"))
    return names.sidecars(rows, "vtt").select("out", "id", "path")


def http_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = K("k")
    code = F.element_at(F.array(*map(F.lit, (200, 404, 408, 429, 500, 501, 503))), (k % 7 + 1).cast("int"))
    header = F.when(k % 3 == 0, _text(k)).when(k % 3 == 1, F.lit("Tue, 02 Jan 2024 00:01:40 GMT")).otherwise(F.lit("soon"))
    span = F.when(k % 4 != 0, F.struct((k * 10).alias("start"), F.when(k % 4 == 1, F.lit(-1)).otherwise(k * 10 + 99).cast("bigint").alias("end")))
    rows = _suppliers(spark, sf_dir).select("k", code.alias("code"), header.alias("h"), span.alias("span"))
    return rows.select(
        "k", scalars.retriable(K("code")).alias("again"), scalars.retry_after(K("h"), F.to_timestamp_ltz(F.lit("2024-01-02 00:00:00+00:00"))).cast("double").alias("wait_s"), scalars.range_header(K("span")).alias("header"),
        scalars.range_header(scalars.resumed_span(K("span"), k % 2 * 7)).alias("resumed"), scalars.bytes_text(k * k * 5000).alias("shown"),
        names.refresh_seconds((k % 3).cast("double"), F.when(k % 2 == 0, F.lit(5.0)).otherwise(F.lit(0.0)), (k % 5).cast("double")).alias("refresh_s"),
    )


def piece_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of one file told apart by their byte ranges, in batch; the init of the stream where a segment has none."""
    span = F.when(K("event_id") % 3 != 0, F.struct((K("event_id") % 40).alias("start"), (K("event_id") % 40 + 9).alias("end")))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seg_ord"), F.lit("f.mp4").alias("url"), span.alias("range"))
    return segments.deduplicated(rows).select("stream_id", "seg_ord", segments.fetch_key().alias("piece"))


#: Selectors with places for a row's own number and word.
SELECTORS = ["best{0}", "", "none", "all", "lang={1}:for=worst{0}", "bwmin={1}", "{1}=1", "for={1}", "id=({0}", "plistdurmin={0}h30m", "plistdurmax={1}", "{1}", "segsmin={0}.5", "codecs!={1}:bwmax={0}"]


def selector_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors that customers have saved, one in a row: which can be read, and what they take."""
    k, word = K("c_custkey"), F.lower(K("c_mktsegment"))
    texts = [_text(*[(k if x == "{0}" else word if x == "{1}" else x) for x in re.split(r"(\{[01]\})", t) if x] or [""]) for t in SELECTORS]
    saved = table(spark, sf_dir, "customer").select(k.alias("k"), F.element_at(F.array(*texts), (k % len(SELECTORS) + 1).cast("int")).alias("selector"))
    return select.checked(saved).select("k", "selector", "ok", "take", "n", "parts")


def request_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select(
        c.alias("id"), F.when(c % 29 == 0, F.lit("a b")).otherwise(_text("c", c)).alias("channel"), F.when(c % 23 == 0, F.lit("")).otherwise(F.lit("u")).alias("url"), F.element_at(F.array(*map(F.lit, ("hls", "ts", "dash", "", "rtmp"))), (c % 5 + 1).cast("int")).alias("out"),
        F.element_at(F.array(*map(F.lit, ("127.0.0.1:80", "localhost", "0.0.0.0:80", ""))), (c % 4 + 1).cast("int")).alias("listen"), F.when(c % 3 == 0, F.lit("")).otherwise(F.lit("s")).alias("secret"), (c % 7).alias("n_streams"), (c % 11).alias("n_segments"),
        F.when(c % 13 == 0, F.lit("SAMPLE-AES")).otherwise(F.lit("AES-128")).alias("method"), (c % 6 == 1).alias("protected"), (c % 12 == 1).alias("has_key"), (c % 2 == 0).alias("fmp4"),
    )
    return status.refusals(rows).select("id", "reason")


def job_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), (F.col("c_custkey") * 13).alias("id"))
    return status.looked_up(asked, views.jobs(spark, sf_dir))


def channel_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = _suppliers(spark, sf_dir).select(_text("ch", K("k")).alias("channel"), (K("k") * 211).alias("job_id"))
    return status.channel_health(channels, views.jobs(spark, sf_dir))


def viewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), F.col("user_id").alias("viewer"), F.floor(F.col("value") * 1000).cast("bigint").alias("n_bytes"))
    return status.viewers(e)


def pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, (200, 503, 404, 429, 206))), (K("event_id") % 5 + 1).cast("int"))
    return status.pressure(table(spark, sf_dir, "events").select(F.col("user_id").alias("fetch_id"), F.col("event_id").alias("attempt"), code.alias("status")))


def stop_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = K("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), e.alias("n"), (e % 5).cast("double").alias("duration"), (e % 97 != 3).alias("live"), (e % 89 == 5).alias("asked_to_stop"))
    return status.until_stop(rows, 40.0).select("stream_id", "n", "last")


def sink_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where committed pieces lie in their files."""
    rows = views.outcomes(spark, sf_dir).withColumn("data", F.repeat(F.lit("x"), (K("idx") % 7).cast("int")).cast("binary"))
    return sink.placed(rows).select("stream_id", "idx", "offset")


def sink_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.outcomes(spark, sf_dir).withColumn("data", F.repeat(F.lit("x"), (K("idx") % 7).cast("int")).cast("binary"))
    return sink.checkpoints(sink.placed(rows))


def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = K("k")
    box = F.unhex(F.lit("00000010"))
    hidden = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.repeat(F.lit("z"), (k % 9).cast("int")).cast("binary"), box, F.lit("ftypisom").cast("binary"), _text(k).cast("binary"))
    packet = F.concat(F.unhex(F.lit("47")), F.repeat(F.lit("p"), 187).cast("binary"))
    stream = F.concat(F.lit("GIF8").cast("binary"), F.repeat(F.lit("z"), (k % 9).cast("int")).cast("binary"), packet, packet, packet, packet)
    data = F.when(k % 3 == 0, hidden).when(k % 3 == 1, stream).otherwise(_text("plain", k).cast("binary"))
    return _suppliers(spark, sf_dir).select("k", F.lower(F.hex(binary.without_image_header(data))).alias("bare"))


def box_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes inside boxes with 32-bit, 64-bit and open sizes."""
    k = K("k")
    u32 = lambda n: F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0"))
    name = lambda s: F.lit(s).cast("binary")
    load = F.repeat(F.lit("d"), (k % 6).cast("int")).cast("binary")
    inner = F.concat(u32(8 + k % 6), name("tfdt"), load)
    moof = F.concat(u32(16 + 8 + k % 6), name("moof"), u32(8 + 8 + k % 6), name("traf"), inner)
    wide = F.concat(u32(F.lit(1)), name("free"), F.unhex(F.lpad(F.hex((16 + k % 6).cast("bigint")), 16, "0")), load)
    rest = F.concat(u32(F.lit(0)), name("mdat"), _text(k).cast("binary"))
    return binary.boxes(_suppliers(spark, sf_dir).select(k.alias("id"), F.concat(moof, wide, rest).alias("data"))).select("id", "path", "at", "size")


def media_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = K("k")
    u32 = lambda n: F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0"))
    name = lambda s: F.lit(s).cast("binary")
    one = F.concat(u32(F.lit(11)), name("mdat"), F.lit("abc").cast("binary"), u32(F.lit(8)), name("skip"), u32(8 + F.length(_text(k))), name("mdat"), _text(k).cast("binary"))
    return binary.media_data(_suppliers(spark, sf_dir).select(k.alias("id"), one.alias("data"))).select("id", K("body").cast("string").alias("body"))


# Test vectors of NIST SP 800-38A, F.2.2 and F.5.2, first two blocks.
NIST_KEY, NIST_PLAIN = "2b7e151628aed2a6abf7158809cf4f3c", "6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51"
NIST_CBC = ("000102030405060708090a0b0c0d0e0f", "7649abac8119b246cee98e9b12e9197d5086cb9b507219ee95db113a917678b2")
NIST_CTR = ("f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff", "874d6191b620e3261bef6864990db6ce9806f66b7970fdff8617187bb9fffdff")


def aes_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published vectors through both ciphers, cut to a length of each row's own."""
    x = lambda h: F.unhex(F.lit(h))
    n = (K("k") % 33).cast("int")
    cut = lambda h: F.substr(x(h), F.lit(1), n)
    rows = _suppliers(spark, sf_dir).select("k", binary.ctr_decrypt(cut(NIST_CTR[1]), x(NIST_KEY), x(NIST_CTR[0])).alias("ctr"), binary.cbc_decrypt(cut(NIST_CBC[1]), x(NIST_KEY), x(NIST_CBC[0])).alias("cbc"))
    return rows.select("k", F.lower(F.hex("ctr")).alias("ctr"), F.lower(F.hex("cbc")).alias("cbc"))


def _hex_box(kind: str, *parts: str) -> str:
    body = "".join(parts)
    return f"{8 + len(body) // 2:08x}{kind.encode().hex()}{body}"


def _sealed_fragment(cipher: str, iv: str) -> str:
    """Hex of a fragment with one encrypted sample of 32 bytes and 8 bytes to come behind it."""
    trun = lambda offset: _hex_box("trun", "00000201", "00000001", f"{offset:08x}", "00000020")
    moof = lambda offset: _hex_box("moof", _hex_box("traf", _hex_box("tfhd", "00000000", "00000001"), trun(offset), _hex_box("senc", "00000000", "00000001", iv)))
    return moof(len(moof(0)) // 2 + 8) + "00000030" + b"mdat".hex() + cipher


def _sealed_init(scheme: str, iv_size: int, constant: str) -> str:
    """Hex of an init segment: a clear track, then one with an encrypted entry."""
    tenc = _hex_box("tenc", "00000000", "0000", "01", f"{iv_size:02x}", NIST_KEY, f"{len(constant) // 2:02x}{constant}" if constant else "")
    sinf = _hex_box("sinf", _hex_box("frma", b"avc1".hex()), _hex_box("schm", "00000000", scheme.encode().hex(), "00010000"), _hex_box("schi", tenc))
    track = lambda entry: _hex_box("trak", _hex_box("mdia", _hex_box("minf", _hex_box("stbl", _hex_box("stsd", "00000000", "00000001", entry)))))
    return _hex_box("moov", track(_hex_box("mp4a", "00" * 28)), track(_hex_box("encv", "00" * 78, sinf)))


def _chain_pieces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A media piece of each stream, by counters or chaining in turn, and the streams' init segments."""
    rows = _suppliers(spark, sf_dir).withColumnRenamed("k", "stream_id")
    counters = F.col("stream_id") % 2 == 0
    media = F.when(counters, F.lit(_sealed_fragment(NIST_CTR[1], NIST_CTR[0]))).otherwise(F.lit(_sealed_fragment(NIST_CBC[1], "")))
    data = F.concat(F.unhex(media), F.lpad(F.col("stream_id").cast("string"), 8, "0").cast("binary"))
    init = F.when(counters, F.lit(_sealed_init("cenc", 16, ""))).otherwise(F.lit(_sealed_init("cbcs", 0, NIST_CBC[0])))
    none = F.lit(None).cast("binary")
    pieces = rows.select("stream_id", F.lit(False).alias("is_init"), data.alias("data"), none.alias("aes_key"), none.alias("iv"), F.lit(0).alias("seq"), F.when(F.col("stream_id") % 5 != 4, F.unhex(F.lit(NIST_KEY))).alias("cenc_key"))
    return pieces, rows.select("stream_id", F.unhex(init).alias("data"))


def transform_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published vectors as samples of encrypted fragments; every fifth stream has no key and keeps its bytes."""
    out = sink.transformed(*_chain_pieces(spark, sf_dir))
    return out.select("stream_id", F.lower(F.hex(F.substring("data", -40, 40))).alias("tail"))


def init_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What init segments say of their encrypted tracks."""
    inits = _chain_pieces(spark, sf_dir)[1].withColumnRenamed("stream_id", "id")
    return binary.protection(inits).select(F.col("id").alias("stream_id"), "track", "scheme", F.lower(F.hex("kid")).alias("kid"), "iv_size", F.coalesce(F.lower(F.hex("constant_iv")), F.lit("")).alias("constant_iv"))


def file_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges of files that a sink hasn't got yet."""
    k = K("k")
    files = _suppliers(spark, sf_dir).select(k.alias("stream_id"), _text("https://ex.com/", k, ".ts").alias("url"), F.when(k % 7 != 3, k % 11 * 1000).alias("length"))
    pieces = fetch.file_ranges(files, 2048)
    left = fetch.missing(pieces, pieces.filter("(stream_id + idx) % 3 = 0"))
    return left.select("stream_id", "idx", F.col("span.start").alias("first_byte"), F.col("span.end").alias("last_byte"))


QUERIES = {
    f.__name__: f
    for f in (
        hls_master, hls_keys, hls_info, dash_streams, dash_select, dash_live, dash_periods, manifest_catalog, manifest_kinds, refresh_match, page_links, page_links_resolved, cookie_match, key_specs, data_keys,
        subtitle_kinds, ttml_parse, resume_points, track_names, file_names, sidecar_names, http_scalars, piece_keys, selector_errors, request_refusals, job_view, channel_health, viewers, pressure, stop_rules,
        sink_offsets, sink_checkpoints, image_headers, box_walk, media_data, aes_vectors, transform_chain, init_tracks, file_ranges,
    )
} | {"dash_counted": _dash("^r"), "dash_list": _dash("^a"), "dash_single": _dash("^t")}

_PAD = "CASE WHEN len(({0})::VARCHAR) < {1} THEN lpad(({0})::VARCHAR, {1}, '0') ELSE ({0})::VARCHAR END"
_DASH_COLUMNS = "s_suppkey AS manifest_id, {id} AS stream_id, {ord}::BIGINT AS seg_ord, {seq}::BIGINT AS seq, {url} AS url, {dur}::DOUBLE AS duration, {a}::BIGINT AS first_byte, {b}::BIGINT AS last_byte, {i}::BIGINT AS init_end"
_COUNT = "ceil((20 + s_suppkey % 7) / (s_suppkey % 5 + 2)::DOUBLE)::BIGINT"

ORACLE = {
    "hls_master": with_views(
        """SELECT manifest_id, CASE media_type WHEN 'video' THEN 'v' WHEN 'audio' THEN 'a' ELSE 's' END || row_number() OVER (PARTITION BY manifest_id, media_type ORDER BY ord) AS id,
               row_number() OVER (PARTITION BY manifest_id ORDER BY ord) - 1 AS ord, media_type, 'https://ex.com/hls/' || CASE media_type WHEN 'video' THEN 'v/' ELSE 'r/' END || id || '.m3u8' AS playlist_url,
               CASE media_type WHEN 'video' THEN bandwidth ELSE 0 END AS bandwidth, width, height, language, audio_group, group_id, muxed_audio FROM v_streams""",
        "v_streams",
    ),
    "hls_keys": """
        WITH e AS (SELECT user_id AS stream_id, event_id, row_number() OVER w - 1 AS seg_ord,
                CASE event_id % 24 WHEN 0 THEN {'m': NULL, 'u': NULL, 'i': NULL} WHEN 6 THEN {'m': 'AES-128', 'u': 'https://ex.com/a/k/' || event_id || '.bin', 'i': lpad(lower(to_hex(event_id)), 32, '0')}
                    WHEN 12 THEN {'m': 'CENC', 'u': '', 'i': NULL} WHEN 18 THEN {'m': 'AES-128', 'u': 'data:,' || event_id, 'i': NULL} END AS key,
                CASE WHEN event_id % 10 = 0 THEN 'https://ex.com/a/i' || event_id || '.mp4' END AS init FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        f AS (SELECT stream_id, seg_ord, last_value(key IGNORE NULLS) OVER w AS key, coalesce(last_value(init IGNORE NULLS) OVER w, last_value(init IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS init_url
              FROM e WINDOW w AS (PARTITION BY stream_id ORDER BY event_id))
        SELECT stream_id, seg_ord, key.m AS method, key.u AS key_uri, key.i AS iv, init_url FROM f""",
    "hls_info": with_views(
        """, g AS (SELECT track_id, greatest(1, ceil(max(dur))) AS target FROM v_window GROUP BY 1), l AS (SELECT track_id, min(seq) AS media_seq FROM v_visible GROUP BY 1)
        SELECT track_id AS manifest_id, NOT ended AS live, media_seq, target::DOUBLE AS target_dur, CASE WHEN ended THEN 0.0 ELSE target / 2 END::DOUBLE AS refresh_s FROM v_tracks JOIN g USING (track_id) JOIN l USING (track_id)""",
        "v_arrivals", "v_tracks", "v_window", "v_visible",
    ).replace(") , g AS", "), g AS"),
    "dash_counted": "SELECT " + _DASH_COLUMNS.format(id="'r' || s_suppkey || '.0.0'", ord="i", seq="s_suppkey + i", url="'https://ex.com/d/vr' || s_suppkey || '-' || " + _PAD.format("s_suppkey + i", 3) + " || '.mp4'", dur="(s_suppkey % 5 + 2)", a="NULL", b="NULL", i="NULL") + f" FROM (SELECT s_suppkey, unnest(range({_COUNT})) AS i FROM supplier)",
    "dash_list": "SELECT " + _DASH_COLUMNS.format(id="'a.1.0'", ord="i", seq="i", url="'https://ex.com/d/a/f.mp4'", dur="4", a="s_suppkey + 1 + 10 * i", b="s_suppkey + 10 + 20 * i", i="s_suppkey") + " FROM supplier, (VALUES (0), (1)) t(i)",
    "dash_single": "SELECT " + _DASH_COLUMNS.format(id="'t' || s_suppkey || '.2.0'", ord="0", seq="0", url="'https://ex.com/d/subs.ttml'", dur="(20 + s_suppkey % 7)", a="NULL", b="NULL", i="NULL") + " FROM supplier",
    "dash_streams": f"""
        SELECT s_suppkey AS manifest_id, x.* FROM supplier, LATERAL (VALUES
            ('r' || s_suppkey || '.0.0', 0::BIGINT, 'video', s_suppkey * 1000, 640, 29.97::DOUBLE, '', {_COUNT}, ({_COUNT} * (s_suppkey % 5 + 2))::DOUBLE),
            ('a.1.0', 1, 'audio', 64000, 0, 0, 'fi', 2, 8), ('t' || s_suppkey || '.2.0', 2, 'subtitles', 0, 0, 0, 'de', 1, (20 + s_suppkey % 7)::DOUBLE)) x(id, ord, media_type, bandwidth, width, frame_rate, language, n_segs, dur_s)""",
    "dash_select": f"""
        SELECT manifest_id, (row_number() OVER (PARTITION BY manifest_id ORDER BY id[1] = 'r' DESC, id[1]))::INT AS pick, id, media_type FROM (
            SELECT s_suppkey AS manifest_id, 'r' || s_suppkey || '.0.0' AS id, 'video' AS media_type FROM supplier WHERE {_COUNT} >= 5
            UNION ALL SELECT s_suppkey, 'a.1.0', 'audio' FROM supplier UNION ALL SELECT s_suppkey, 't' || s_suppkey || '.2.0', 'subtitles' FROM supplier)""",
    "dash_live": """
        WITH c AS (SELECT s_suppkey AS k, s_suppkey % 5 + 2 AS d, ceil(20 / (s_suppkey % 5 + 2)::DOUBLE)::BIGINT AS n FROM supplier)
        SELECT k AS manifest_id, i AS seg_ord, k + greatest(600 // d - n, 0) + i AS seq, 'https://ex.com/d/' || (k + greatest(600 // d - n, 0) + i) AS url FROM (SELECT *, unnest(range(n)) AS i FROM c)""",
    "dash_periods": """
        WITH r AS (SELECT s_suppkey AS k, c, p, s_suppkey % 2 = 1 AND p = 1 AS other FROM supplier, (VALUES ('a', 0), ('b', 1), ('c', 2)) t(c, p)),
        f AS (SELECT k AS manifest_id, CASE WHEN other THEN 'film.0.0.p1' ELSE 'film.0.0' END AS stream_id, (row_number() OVER (PARTITION BY k, other ORDER BY p) - 1) AS seg_ord, 'https://ex.com/cinema/show/reel/' || c || '/' || k || '.mp4' AS url FROM r)
        SELECT manifest_id, stream_id, seg_ord, seg_ord AS seq, url, seg_ord > 0 AS discontinuity FROM f
        UNION ALL SELECT s_suppkey, 'talk.1.0', 0, 0, 'https://ex.com/cinema/show/talk.mp3', false FROM supplier""",
    "manifest_catalog": """
        SELECT s_suppkey AS manifest_id, 'v1' AS id, 'video' AS media_type, CASE s_suppkey % 4 WHEN 0 THEN 'https://ex.com/w/x.m3u8' ELSE 'https://ex.com/m/' || s_suppkey || '.m3u8' END AS playlist_url,
               CASE s_suppkey % 4 WHEN 0 THEN s_suppkey + 1 ELSE 0 END AS bandwidth FROM supplier WHERE s_suppkey % 4 <> 1
        UNION ALL SELECT s_suppkey, x.id, x.t, 'https://ex.com/w/page', x.b FROM supplier, LATERAL (VALUES ('r' || s_suppkey || '.0.0', 'video', s_suppkey * 1000), ('a.1.0', 'audio', 64000), ('t' || s_suppkey || '.2.0', 'subtitles', 0)) x(id, t, b) WHERE s_suppkey % 4 = 1""",
    "manifest_kinds": """
        WITH a AS (SELECT s_suppkey % 4 AS r, s_suppkey AS k FROM supplier),
        b AS (SELECT CASE r WHEN 0 THEN 'hls' WHEN 1 THEN 'dash' ELSE 'page' END AS kind, 'https://ex.com/w/page' AS base FROM a UNION ALL SELECT 'hls', 'https://ex.com/m/' || k || '.m3u8' FROM a
              UNION ALL SELECT 'page', 'https://ex.com/w/f/' || k || '.html' FROM a UNION ALL SELECT 'hls', 'file:///data/' || k || '.m3u8' FROM a)
        SELECT kind, base[1:5] = 'file:' AS is_local, count(*) AS n, max(base) AS last_base FROM b GROUP BY ALL""",
    "refresh_match": f"SELECT s_suppkey AS manifest_id, 'r' || s_suppkey || '.0.0' AS id, s_suppkey % 3 = 0 AS lost, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE {_COUNT} END AS n FROM supplier",
    "page_links": "SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN 3 ELSE 0 END::BIGINT AS n_links, CASE WHEN page_id % 5 <> 0 THEN 'https://cdn.ex.com/' || page_id || '/live.mpd?x=1&y http://ex.net/a.m3u8 v/' || page_id || '.m3u8' ELSE '' END AS links FROM pages",
    "page_links_resolved": "SELECT page_id, p::INT AS place, CASE p WHEN 0 THEN 'https://cdn.ex.com/' || page_id || '/live.mpd?x=1&y' WHEN 1 THEN 'http://ex.net/a.m3u8' ELSE 'https://site.ex/dir/v/' || page_id || '.m3u8' END AS link FROM pages, (VALUES (0), (1), (2)) t(p) WHERE page_id % 5 <> 0",
    "cookie_match": """
        SELECT CASE WHEN k % 2 = 0 THEN 'http' ELSE 'https' END || '://w.ex' || n || '.com/' || CASE WHEN k % 4 < 2 THEN 'a/' ELSE 'b/' END || k AS url, 'c' || n AS name, 'v' || n AS value
        FROM (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier) WHERE n < (SELECT count(*) FROM nation) AND (n % 3 <> 0 OR k % 4 < 2) AND (n % 5 <> 0 OR k % 2 = 1)""",
    "key_specs": "SELECT CASE WHEN k % 4 = 2 THEN repeat('0', 32) ELSE h END AS kid, CASE WHEN k % 4 = 0 THEN reverse(h) ELSE h END AS key FROM (SELECT s_suppkey AS k, md5(s_suppkey::VARCHAR) AS h FROM supplier) WHERE k % 4 <> 3",
    "data_keys": """
        SELECT CASE k % 3 WHEN 0 THEN 'data:text/plain;base64,' || base64(unhex(h)) WHEN 1 THEN 'data:,' || h[1:16] ELSE 'data:,' || h END AS uri, CASE k % 3 WHEN 0 THEN h WHEN 1 THEN lower(hex(encode(h[1:16]))) END AS key
        FROM (SELECT s_suppkey AS k, md5(s_suppkey::VARCHAR) AS h FROM supplier)""",
    "subtitle_kinds": "SELECT p_partkey AS k, ['vtt', 'ttml', 'ttml', 'srt', 'fmp4', 'unknown'][p_partkey % 6 + 1] AS kind FROM part",
    "ttml_parse": """SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS cue_ord, event_id + 0.5::DOUBLE AS start, (event_id + 2)::DOUBLE AS "end", event_type || chr(10) || '& ' || event_id AS text FROM events""",
    "resume_points": "SELECT k AS stream_id, CASE WHEN ok THEN k ELSE 0 END AS next_idx, CASE WHEN ok THEN k * 10 ELSE 0 END AS \"offset\" FROM (SELECT s_suppkey AS k, s_suppkey % 5 <> 4 AND s_suppkey % 3 <> 0 AS ok FROM supplier)",
    "track_names": with_views(
        """, b AS (SELECT *, CASE media_type WHEN 'subtitles' THEN 'sub' ELSE media_type END || CASE WHEN media_type <> 'video' AND language <> '' THEN '-' || language ELSE '' END AS base FROM v_streams),
        c AS (SELECT *, row_number() OVER (PARTITION BY manifest_id, base ORDER BY ord) AS n FROM b) SELECT manifest_id, id, base || CASE WHEN n = 1 THEN '' ELSE n::VARCHAR END AS track_id FROM c""",
        "v_streams",
    ).replace(") , b AS", "), b AS"),
    "file_names": """
        WITH a AS (SELECT s_suppkey AS k FROM supplier),
        b AS (SELECT k, CASE k % 3 WHEN 0 THEN 'show-' || k || CASE WHEN k % 2 = 0 THEN '-20240102' ELSE '' END || '.mp4' WHEN 1 THEN 'clip' || k || '.mp4' ELSE 'clip' || k || '.mkv' END AS path FROM a)
        SELECT k, path, CASE WHEN k % 4 = 0 THEN '.rawsub' WHEN k % 5 = 0 THEN '.mp4' ELSE '.ts' END AS raw, CASE WHEN k % 2 = 0 THEN 'video/mp2t' ELSE 'video/mp4' END AS mime,
               CASE WHEN k % 2 = 1 THEN 'N' || k WHEN k % 3 <> 0 THEN 'fi' ELSE 't' || k END AS shown, CASE WHEN k % 2 = 0 THEN 'dash' ELSE 'hls' END AS format, CASE WHEN k % 3 = 2 THEN 'srt' ELSE 'mov_text' END AS codec FROM b""",
    "sidecar_names": with_views(
        """, b AS (SELECT manifest_id, id, CASE WHEN language = '' THEN 'sub' ELSE language END AS tag, ord FROM v_streams WHERE media_type = 'subtitles')
        SELECT manifest_id || '.mp4' AS out, id, manifest_id || '.' || tag || CASE WHEN row_number() OVER (PARTITION BY manifest_id, tag ORDER BY ord) = 1 THEN '' ELSE '.' || id END || '.vtt' AS path FROM b""",
        "v_streams",
    ).replace(") , b AS", "), b AS"),
    "http_scalars": """
        WITH a AS (SELECT s_suppkey AS k, s_suppkey * s_suppkey * 5000 AS n, [200, 404, 408, 429, 500, 501, 503][s_suppkey % 7 + 1] AS code FROM supplier)
        SELECT k, code IN (408, 429, 500, 502, 503, 504) AS again, CASE k % 3 WHEN 0 THEN k WHEN 1 THEN 100 ELSE 0 END::DOUBLE AS wait_s,
               CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'bytes=' || k * 10 || '-' ELSE 'bytes=' || k * 10 || '-' || (k * 10 + 99) END AS header,
               CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'bytes=' || (k * 10 + 7) || '-' WHEN 2 THEN 'bytes=' || k * 10 || '-' || (k * 10 + 99) ELSE 'bytes=' || (k * 10 + 7) || '-' || (k * 10 + 99) END AS resumed,
               CASE WHEN n >= 1 << 30 THEN printf('%.1f GB', n / (1 << 30)::DOUBLE) WHEN n >= 1 << 20 THEN printf('%.1f MB', n / (1 << 20)::DOUBLE) WHEN n >= 1 << 10 THEN printf('%.1f KB', n / 1024::DOUBLE) ELSE n || ' B' END AS shown,
               CASE WHEN k % 3 > 0 THEN (k % 3) / 2 WHEN k % 2 = 0 THEN 5.0 WHEN k % 5 > 0 THEN greatest((k % 5) / 2, 2.0) ELSE 4.0 END::DOUBLE AS refresh_s FROM a""",
    "piece_keys": """
        SELECT stream_id, seg_ord, piece FROM (SELECT user_id AS stream_id, event_id AS seg_ord, 'f.mp4' || CASE WHEN event_id % 3 <> 0 THEN '@' || event_id % 40 || '-' || (event_id % 40 + 9) ELSE '' END AS piece FROM events)
        QUALIFY row_number() OVER (PARTITION BY stream_id, piece ORDER BY seg_ord) = 1""",
    "selector_errors": """
        WITH a AS (SELECT c_custkey AS k, lower(c_mktsegment) AS w, c_custkey % 14 AS r FROM customer)
        SELECT k, ['best' || k, '', 'none', 'all', 'lang=' || w || ':for=worst' || k, 'bwmin=' || w, w || '=1', 'for=' || w, 'id=(' || k, 'plistdurmin=' || k || 'h30m', 'plistdurmax=' || w, w, 'segsmin=' || k || '.5', 'codecs!=' || w || ':bwmax=' || k][r + 1] AS selector,
               r IN (0, 1, 2, 3, 4, 9, 13) AS ok, CASE r WHEN 0 THEN 'best' WHEN 1 THEN 'nothing' WHEN 2 THEN 'nothing' WHEN 3 THEN 'all' WHEN 4 THEN 'worst' WHEN 9 THEN 'all' WHEN 13 THEN 'all' ELSE '' END AS take,
               CASE WHEN r IN (0, 4) THEN k WHEN r IN (1, 2, 3, 9, 13) THEN 1 ELSE 0 END::INT AS n, CASE r WHEN 4 THEN 1 WHEN 9 THEN 1 WHEN 13 THEN 2 ELSE 0 END::INT AS parts FROM a""",
    "request_refusals": """
        SELECT id, reason FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 29 = 0 THEN 'channel id' WHEN o_orderkey % 23 = 0 THEN 'no address' WHEN o_orderkey % 5 = 4 THEN 'unknown format'
            WHEN o_orderkey % 4 = 2 AND o_orderkey % 3 = 0 THEN 'open address needs a secret' WHEN o_orderkey % 7 = 0 THEN 'nothing selected' WHEN o_orderkey % 11 = 0 THEN 'no segments' WHEN o_orderkey % 13 = 0 THEN 'sample encryption'
            WHEN o_orderkey % 6 = 1 AND o_orderkey % 12 <> 1 THEN 'protected without key' WHEN o_orderkey % 5 = 2 AND o_orderkey % 2 <> 0 THEN 'not fragmented' END AS reason FROM orders) WHERE reason IS NOT NULL""",
    "job_view": with_views("SELECT c_custkey AS request_id, c_custkey * 13 AS id, state IS NOT NULL AS found, coalesce(state, '') AS state FROM customer LEFT JOIN v_jobs j ON j.id = c_custkey * 13", "v_jobs"),
    "channel_health": with_views("SELECT 'ch' || s_suppkey AS channel, s_suppkey * 211 AS job_id, coalesce(state, 'missing') AS state, coalesce(state = 'running', false) AS healthy FROM supplier LEFT JOIN v_jobs j ON j.id = s_suppkey * 211", "v_jobs"),
    "viewers": """
        SELECT *, CASE WHEN bytes >= 1 << 30 THEN printf('%.1f GB', bytes / (1 << 30)::DOUBLE) WHEN bytes >= 1 << 20 THEN printf('%.1f MB', bytes / (1 << 20)::DOUBLE) WHEN bytes >= 1 << 10 THEN printf('%.1f KB', bytes / 1024::DOUBLE) ELSE bytes || ' B' END AS shown
        FROM (SELECT event_type AS channel, count(DISTINCT user_id) AS viewers, count(*) AS segments, sum(floor(value * 1000)::BIGINT)::BIGINT AS bytes FROM events GROUP BY 1)""",
    "pressure": "SELECT user_id AS fetch_id, count(*) AS attempts, count(*) FILTER (event_id % 5 IN (1, 3)) AS pressure, arg_max([200, 503, 404, 429, 206][event_id % 5 + 1], event_id) AS status FROM events GROUP BY 1",
    "stop_rules": """
        WITH a AS (SELECT user_id AS stream_id, event_id AS n, sum(event_id % 5) OVER (PARTITION BY user_id ORDER BY event_id) >= 40 OR event_id % 97 = 3 OR event_id % 89 = 5 AS ended FROM events)
        SELECT stream_id, n, ended AS last FROM a QUALIFY NOT coalesce(bool_or(ended) OVER (PARTITION BY stream_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)""",
    "sink_offsets": with_views(
        """, c AS (SELECT o.* FROM v_outcomes o LEFT JOIN (SELECT stream_id, min(idx) AS stop FROM v_outcomes WHERE NOT ok GROUP BY 1) s USING (stream_id) WHERE stop IS NULL OR idx < stop)
        SELECT stream_id, idx, (sum(idx % 7) OVER (PARTITION BY stream_id ORDER BY idx) - idx % 7)::BIGINT AS "offset" FROM c""", "v_outcomes").replace(") , c AS", "), c AS"),
    "sink_checkpoints": with_views(
        """, c AS (SELECT o.* FROM v_outcomes o LEFT JOIN (SELECT stream_id, min(idx) AS stop FROM v_outcomes WHERE NOT ok GROUP BY 1) s USING (stream_id) WHERE stop IS NULL OR idx < stop)
        SELECT stream_id, max(idx) + 1 AS next_idx, sum(idx % 7)::BIGINT AS "offset" FROM c GROUP BY 1""", "v_outcomes").replace(") , c AS", "), c AS"),
    "image_headers": """
        SELECT s_suppkey AS k, lower(CASE s_suppkey % 3 WHEN 0 THEN '00000010' || hex(encode('ftypisom' || s_suppkey)) WHEN 1 THEN repeat('47' || repeat('70', 187), 4) ELSE hex(encode('plain' || s_suppkey)) END) AS bare FROM supplier""",
    "box_walk": """
        SELECT s_suppkey AS id, x.* FROM supplier, LATERAL (VALUES ('/moof', 0::BIGINT, 24 + s_suppkey % 6), ('/moof/traf', 8, 16 + s_suppkey % 6), ('/moof/traf/tfdt', 16, 8 + s_suppkey % 6),
            ('/free', 24 + s_suppkey % 6, 16 + s_suppkey % 6), ('/mdat', 40 + 2 * (s_suppkey % 6), 8 + len(s_suppkey::VARCHAR))) x(path, "at", size)""",
    "media_data": "SELECT s_suppkey AS id, 'abc' || s_suppkey AS body FROM supplier",
    "aes_vectors": f"SELECT s_suppkey AS k, '{NIST_PLAIN}'[1:2 * (s_suppkey % 33)] AS ctr, '{NIST_PLAIN}'[1:32 * (s_suppkey % 33 // 16)] AS cbc FROM supplier",
    "transform_chain": f"""SELECT s_suppkey AS stream_id, CASE WHEN s_suppkey % 5 <> 4 THEN '{NIST_PLAIN[:64]}' WHEN s_suppkey % 2 = 0 THEN '{NIST_CTR[1]}' ELSE '{NIST_CBC[1]}' END
        || lower(hex(encode(lpad(s_suppkey::VARCHAR, 8, '0')))) AS tail FROM supplier""",
    "init_tracks": f"""SELECT s_suppkey AS stream_id, 1::INT AS track, CASE WHEN s_suppkey % 2 = 0 THEN 'cenc' ELSE 'cbcs' END AS scheme, '{NIST_KEY}' AS kid, CASE WHEN s_suppkey % 2 = 0 THEN 16 ELSE 0 END::INT AS iv_size,
        CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE '{NIST_CBC[0]}' END AS constant_iv FROM supplier""",
    "file_ranges": """WITH f AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 <> 3 THEN s_suppkey % 11 * 1000 END AS n FROM supplier),
        p AS (SELECT k, n, unnest(CASE WHEN n IS NULL THEN [0] ELSE range(ceil(n / 2048.0)::BIGINT) END) AS i FROM f)
        SELECT k AS stream_id, i::BIGINT AS idx, (i * 2048)::BIGINT AS first_byte, CASE WHEN n IS NULL THEN -1 ELSE least((i + 1) * 2048, n) - 1 END::BIGINT AS last_byte FROM p WHERE (k + i) % 3 <> 0""",
}
