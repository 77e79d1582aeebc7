"""The rolling live window and what is published from it.

Input: arrivals (track_id, arrival, duration, discontinuity, n_bytes) and tracks
(presentation, track_id, ord, media_type, live, ended, fmp4, has_init, bandwidth, codecs, width,
height, frame_rate, language, name, channels, is_default). What tracks make up
together is told by ``presentation``; without that column all are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fixed3, resolution, zero_filled
from ..schemas import first_non_empty, or_empty

#: Segments that a live playlist shows, and how many more stay fetchable.
VISIBLE, TAIL = 6, 3


PRESENTATION = "presentation"


def _told(tracks: DataFrame) -> DataFrame:
    return tracks if PRESENTATION in tracks.columns else tracks.withColumn(PRESENTATION, F.lit(0).cast("long"))


def numbered(arrivals: DataFrame) -> DataFrame:
    """Arrivals with ``dur`` (never 0), ``seq`` from 0, ``start_ms`` and ``newest`` (1 is the last).

    A missing duration becomes the greatest one used before, or 2 s if a track
    begins with one; that 2 s then counts as seen.
    """
    order = Window.partitionBy("track_id").orderBy("arrival")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    given = F.when(F.col("duration") > 0, F.col("duration"))
    seen = F.greatest(F.max(given).over(before), F.when(F.first("duration").over(order) <= 0, F.lit(2.0)))
    rows = arrivals.withColumn("dur", F.coalesce(given, seen, F.lit(2.0))).withColumn("ms", F.floor(F.col("dur") * 1000 + 0.5).cast("bigint"))
    return rows.select(
        "*",
        (F.row_number().over(order) - 1).cast("long").alias("seq"),
        F.coalesce(F.sum("ms").over(before), F.lit(0)).cast("long").alias("start_ms"),
        F.row_number().over(Window.partitionBy("track_id").orderBy(F.col("arrival").desc())).alias("newest"),
    )


def visible(window: DataFrame, tracks: DataFrame) -> DataFrame:
    """What playlists show: the newest six of a live track, all of others."""
    return window.join(tracks.select("track_id", "live", "fmp4"), "track_id").filter(~F.col("live") | (F.col("newest") <= VISIBLE))


def retained(window: DataFrame, tracks: DataFrame) -> DataFrame:
    """What can still be fetched."""
    return window.join(tracks.select("track_id", "live", "fmp4"), "track_id").filter(~F.col("live") | (F.col("newest") <= VISIBLE + TAIL))


def segment_name(seq: Column, fmp4: Column) -> Column:
    return F.concat(zero_filled(seq.cast("string"), 6), F.when(fmp4, F.lit(".m4s")).otherwise(F.lit(".ts")))


def track_stats(window: DataFrame, tracks: DataFrame) -> DataFrame:
    """Per track: published, in_window, target_dur, end_ms, bitrate (declared, else the peak of retained segments)."""
    per = window.groupBy("track_id").agg(F.count(F.lit(1)).alias("published"), F.max("dur").alias("target_dur"), F.max(F.col("start_ms") + F.col("ms")).alias("end_ms"))
    kept = retained(window, tracks).groupBy("track_id").agg(F.count(F.lit(1)).alias("in_window"), F.max(F.floor(F.col("n_bytes") * 8 / F.col("dur")).cast("bigint")).alias("peak"))
    out = tracks.join(per, "track_id", "left").join(kept, "track_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(
        *[c for c in tracks.columns],
        zero("published").alias("published"),
        zero("in_window").alias("in_window"),
        F.coalesce("target_dur", F.lit(0.0)).alias("target_dur"),
        zero("end_ms").alias("end_ms"),
        F.when(F.col("bandwidth") > 0, F.col("bandwidth")).otherwise(zero("peak")).alias("bitrate"),
    )


def ready(stats: DataFrame) -> DataFrame:
    """Per presentation: whether every track has a segment."""
    return _told(stats).groupBy(PRESENTATION).agg(F.coalesce(F.bool_and(F.col("published") > 0), F.lit(False)).alias("ready"))


def presentation(stats: DataFrame) -> DataFrame:
    """Per presentation: live, target duration (2 if unknown) and length of the whole."""
    target = F.max("target_dur")
    return _told(stats).groupBy(PRESENTATION).agg(F.bool_or("live").alias("live"), F.when(target > 0, target).otherwise(F.lit(2.0)).alias("target_dur"), F.max("end_ms").alias("length_ms"))


def media_playlists(window: DataFrame, tracks: DataFrame) -> DataFrame:
    """track_id, body: the media playlist of each track."""
    lines = F.concat(F.when(F.col("discontinuity"), F.lit("#EXT-X-DISCONTINUITY\n")).otherwise(F.lit("")), F.lit("#EXTINF:"), fixed3(F.col("ms")), F.lit(",\n"), segment_name(F.col("seq"), F.col("fmp4")), F.lit("\n"))
    shown = visible(window, tracks).groupBy("track_id").agg(F.min("seq").alias("first_seq"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", lines.alias("l")))), lambda x: x["l"]), "").alias("lines"))
    target = window.groupBy("track_id").agg(F.greatest(F.max(F.ceil("dur")), F.lit(1)).cast("string").alias("target"))
    rows = tracks.join(shown, "track_id", "left").join(target, "track_id", "left")
    return rows.select(
        "track_id",
        F.concat(
            F.lit("#EXTM3U\n#EXT-X-VERSION:"),
            F.when(F.col("fmp4"), F.lit("6")).otherwise(F.lit("3")),
            F.lit("\n#EXT-X-TARGETDURATION:"),
            F.coalesce("target", F.lit("1")),
            F.lit("\n#EXT-X-MEDIA-SEQUENCE:"),
            F.coalesce(F.col("first_seq").cast("string"), F.lit("0")),
            F.lit("\n"),
            F.when(F.col("fmp4") & F.col("has_init"), F.lit('#EXT-X-MAP:URI="init.mp4"\n')).otherwise(F.lit("")),
            F.coalesce("lines", F.lit("")),
            F.when(F.col("ended"), F.lit("#EXT-X-ENDLIST\n")).otherwise(F.lit("")),
        ).alias("body"),
    )


def timelines(window: DataFrame, tracks: DataFrame) -> DataFrame:
    """track_id, run, t, d, r: neighbours of equal rounded duration as one entry; ``r`` counts the repeats."""
    order = Window.partitionBy("track_id").orderBy("seq")
    runs = visible(window, tracks).withColumn("_new", F.coalesce((F.lag("ms").over(order) != F.col("ms")).cast("int"), F.lit(1))).withColumn("run", F.sum("_new").over(order))
    return runs.groupBy("track_id", "run").agg(F.min("start_ms").alias("t"), F.min("ms").alias("d"), (F.count(F.lit(1)) - 1).alias("r"))


def _ordered(rows: DataFrame, by: str, text: Column, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by), text.alias("x")))), lambda x: x["x"]), "").alias("text"))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _attribute(name: str, value: Column, given: Column, quoted: bool = True) -> Column:
    return F.when(given, F.concat(F.lit(f"{name}="), _quoted(value) if quoted else value))


def master_playlist(stats: DataFrame, audio_group: str = "aud", subs_group: str = "subs") -> DataFrame:
    """presentation, body: the multivariant playlist of each. Tracks in the order of ``ord``."""
    stats = _told(stats)
    kind = F.col("media_type")
    first = F.row_number().over(Window.partitionBy(PRESENTATION, "media_type").orderBy("ord")) == 1
    shown = first_non_empty(F.col("name"), F.col("language"), F.col("track_id").cast("string"))
    flag = F.when(first | F.col("is_default"), F.lit("YES")).otherwise(F.lit("NO"))
    group = F.when(kind == "audio", F.lit(audio_group)).otherwise(F.lit(subs_group))
    media = F.concat(
        F.lit("#EXT-X-MEDIA:"),
        F.concat_ws(
            ",",
            F.concat(F.lit("TYPE="), F.upper(kind)),
            F.concat(F.lit("GROUP-ID="), _quoted(group)),
            F.concat(F.lit("NAME="), _quoted(shown)),
            F.concat(F.lit("DEFAULT="), flag),
            F.concat(F.lit("AUTOSELECT="), flag),
            _attribute("LANGUAGE", F.col("language"), F.col("language") != ""),
            _attribute("CHANNELS", F.col("channels"), (kind == "audio") & (F.col("channels") != "")),
            F.concat(F.lit("URI="), _quoted(F.concat("track_id", F.lit("/index.m3u8")))),
        ),
        F.lit("\n"),
    )
    renditions = stats.filter(kind.isin("audio", "subtitles")).withColumn("line", media).withColumn("at", F.struct("media_type", "ord"))
    of_kind = lambda k: F.count_if(kind == k)
    first_sound = F.min_by(F.struct("bitrate", "codecs", "track_id"), F.when(kind == "audio", F.col("ord"))).alias("a")
    about = stats.groupBy(PRESENTATION).agg(first_sound, of_kind("audio").alias("n_audio"), of_kind("subtitles").alias("n_subs"), of_kind("video").alias("n_video"))
    rate = F.col("bitrate") + F.coalesce("a.bitrate", F.lit(0))
    codecs = F.when((F.col("codecs") != "") & (F.coalesce("a.codecs", F.lit("")) != ""), F.concat("codecs", F.lit(","), "a.codecs")).otherwise(F.col("codecs"))
    size = resolution(F.col("width"), F.col("height"))
    variant = F.concat(
        F.lit("#EXT-X-STREAM-INF:"),
        F.concat_ws(
            ",",
            F.concat(F.lit("BANDWIDTH="), F.when(rate == 0, F.lit(2_000_000)).otherwise(rate).cast("string")),
            _attribute("CODECS", codecs, codecs != ""),
            _attribute("RESOLUTION", size, size != "", quoted=False),
            _attribute("FRAME-RATE", fixed3(F.floor(F.col("frame_rate") * 1000 + 0.5).cast("bigint")), F.col("frame_rate") > 0, quoted=False),
            _attribute("AUDIO", F.lit(audio_group), F.col("n_audio") > 0),
            _attribute("SUBTITLES", F.lit(subs_group), F.col("n_subs") > 0),
        ),
        F.lit("\n"),
        F.col("track_id"),
        F.lit("/index.m3u8\n"),
    )
    variants = _ordered(stats.filter(kind == "video").join(about, PRESENTATION).withColumn("line", variant), "ord", F.col("line"), PRESENTATION)
    alone = F.concat(
        F.lit("#EXT-X-STREAM-INF:BANDWIDTH="),
        F.when(F.col("a.bitrate") == 0, F.lit(128_000)).otherwise(F.col("a.bitrate")).cast("string"),
        F.when(F.col("a.codecs") != "", F.concat(F.lit(',CODECS="'), "a.codecs", F.lit('"'))).otherwise(F.lit("")),
        F.lit("\n"),
        F.col("a.track_id"),
        F.lit("/index.m3u8\n"),
    )
    head = _ordered(renditions, "at", F.col("line"), PRESENTATION).withColumnRenamed("text", "media")
    whole = about.join(head, PRESENTATION, "left").join(variants, PRESENTATION, "left")
    only = F.when((F.col("n_video") == 0) & (F.col("n_audio") > 0), alone).otherwise(F.lit(""))
    return whole.select(PRESENTATION, F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:6\n"), or_empty(F.col("media")), or_empty(F.col("text")), only).alias("body"))


def _seconds(seconds: Column, digits: int) -> Column:
    """Seconds with one or no decimal; what lies half-way goes to the even neighbour."""
    return F.format_string(f"%.{digits}f", F.bround(seconds, digits))


def dash_manifest(window: DataFrame, tracks: DataFrame, started: str, now: str) -> DataFrame:
    """presentation, body: the MPD of each. ``started`` and ``now`` are its wall-clock times, written as given."""
    tracks = _told(tracks)
    stats = track_stats(window, tracks).filter(F.col("media_type").isin("video", "audio"))
    entry = F.concat(
        F.lit('            <S t="'), F.col("t").cast("string"), F.lit('" d="'), F.col("d").cast("string"), F.lit('"'),
        F.when(F.col("r") > 0, F.concat(F.lit(' r="'), F.col("r").cast("string"), F.lit('"'))).otherwise(F.lit("")), F.lit("/>\n"),
    )
    lines = _ordered(timelines(window, tracks).withColumn("e", entry), "run", F.col("e"), "track_id").withColumnRenamed("text", "entries")
    starts = visible(window, tracks).groupBy("track_id").agg(F.min("seq").cast("string").alias("first_seq"))
    video = F.col("media_type") == "video"
    optional = lambda given, *parts: F.when(given, F.concat(*parts)).otherwise(F.lit(""))
    block = F.concat(
        F.lit('    <AdaptationSet contentType="'), F.col("media_type"), F.lit('" mimeType="'), F.col("media_type"), F.lit('/mp4" segmentAlignment="true"'),
        optional(F.col("language") != "", F.lit(' lang="'), F.col("language"), F.lit('"')),
        F.lit('>\n      <Representation id="'), F.col("track_id"), F.lit('" bandwidth="'), F.when(F.col("bitrate") == 0, F.lit(2_000_000)).otherwise(F.col("bitrate")).cast("string"), F.lit('"'),
        optional(F.col("codecs") != "", F.lit(' codecs="'), F.col("codecs"), F.lit('"')),
        optional(video & ((F.col("width") > 0) | (F.col("height") > 0)), F.lit(' width="'), F.col("width").cast("string"), F.lit('" height="'), F.col("height").cast("string"), F.lit('"')),
        optional(video & (F.col("frame_rate") > 0), F.lit(' frameRate="'), F.regexp_replace(F.col("frame_rate").cast("string"), r"\.0$", ""), F.lit('"')),
        F.lit(">\n"),
        optional(~video & (F.col("channels") != ""), F.lit('        <AudioChannelConfiguration schemeIdUri="urn:mpeg:dash:23003:3:audio_channel_configuration:2011" value="'), F.col("channels"), F.lit('"/>\n')),
        F.lit('        <SegmentTemplate timescale="1000" initialization="$RepresentationID$/init.mp4" media="$RepresentationID$/$Number%06d$.m4s" startNumber="'),
        F.coalesce("first_seq", F.lit("0")), F.lit('">\n          <SegmentTimeline>\n'), F.coalesce("entries", F.lit("")),
        F.lit("          </SegmentTimeline>\n        </SegmentTemplate>\n      </Representation>\n    </AdaptationSet>\n"),
    )
    sets = stats.join(lines, "track_id", "left").join(starts, "track_id", "left").withColumn("block", block).withColumn("at", F.struct((~video).alias("late"), "ord"))
    body = _ordered(sets, "at", F.col("block"), PRESENTATION)
    whole = presentation(track_stats(window, tracks)).join(body, PRESENTATION, "left")
    td = F.col("target_dur")
    live = F.col("live")
    return whole.select(
        PRESENTATION,
        F.concat(
            F.lit('<?xml version="1.0" encoding="utf-8"?>\n<MPD xmlns="urn:mpeg:dash:schema:mpd:2011" profiles="urn:mpeg:dash:profile:isoff-'),
            F.when(live, F.lit('live:2011" type="dynamic"')).otherwise(F.lit('on-demand:2011" type="static"')),
            F.lit(' minBufferTime="PT'), _seconds(td, 1), F.lit('S"'),
            F.when(live, F.concat(F.lit(f' availabilityStartTime="{started}" publishTime="{now}" minimumUpdatePeriod="PT'), _seconds(td, 0), F.lit('S" timeShiftBufferDepth="PT'), _seconds(td * VISIBLE, 0), F.lit('S" suggestedPresentationDelay="PT'), _seconds(td * 3, 0), F.lit('S"')))
            .otherwise(F.concat(F.lit(' mediaPresentationDuration="PT'), fixed3(F.col("length_ms")), F.lit('S"'))),
            F.lit('>\n  <Period id="0" start="PT0S">\n'), or_empty(F.col("text")), F.lit("  </Period>\n</MPD>\n"),
        ).alias("body")
    )
