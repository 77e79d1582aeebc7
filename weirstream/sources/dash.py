"""DASH manifests (MPD) as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import byte_span, frame_rate, iso_seconds
from ..functions.urls import resolve
from ..schemas import first_non_empty, number, or_empty

_S = "struct<_t:string,_d:string,_r:string>"
_TEMPLATE = f"struct<_media:string,_initialization:string,_timescale:string,_duration:string,_startNumber:string,SegmentTimeline:struct<S:array<{_S}>>>"
_LIST = "struct<_timescale:string,_duration:string,Initialization:struct<_sourceURL:string,_range:string>,SegmentURL:array<struct<_media:string,_mediaRange:string>>>"
_PROTECTION = "array<struct<_schemeIdUri:string,_default_KID:string>>"
_VALUE = "array<struct<_value:string>>"
_COMMON = f"_mimeType:string,_codecs:string,_lang:string,_frameRate:string,BaseURL:array<string>,ContentProtection:{_PROTECTION},SegmentTemplate:{_TEMPLATE},SegmentList:{_LIST}"
_REPRESENTATION = f"struct<_id:string,_bandwidth:string,_width:string,_height:string,AudioChannelConfiguration:{_VALUE},{_COMMON}>"
_SET = f"struct<_contentType:string,Role:{_VALUE},Representation:array<{_REPRESENTATION}>,{_COMMON}>"
_PERIOD = f"struct<_id:string,_start:string,_duration:string,BaseURL:array<string>,AdaptationSet:array<{_SET}>>"
MPD = (
    "_type string, _mediaPresentationDuration string, _timeShiftBufferDepth string, _minimumUpdatePeriod string, _availabilityStartTime string,"
    f" BaseURL array<string>, Period array<{_PERIOD}>"
)


def is_dash(body: Column) -> Column:
    head = F.substr(body, F.lit(1), F.lit(512))
    return F.contains(head, F.lit("<MPD")) | (F.contains(head, F.lit("<?xml")) & F.contains(body, F.lit("<MPD")))


def expanded(template: Column, rep_id: Column, bandwidth: Column, num: Column, time: Column) -> Column:
    """A template's variables filled in; %0Nd pads with zeros and never cuts; $$ is a dollar sign."""
    out = F.replace(template, F.lit("$RepresentationID$"), rep_id)
    for name, value in (("Bandwidth", bandwidth), ("Number", num), ("Time", time)):
        text = value.cast("string")
        out = F.replace(out, F.lit(f"${name}$"), text)
        rx = rf"\${name}%0(\d+)d\$"
        width = F.coalesce(F.regexp_extract(out, rx, 1).try_cast("int"), F.lit(0))
        out = F.when(out.rlike(rx), F.regexp_replace(out, F.lit(rx), F.when(F.length(text) < width, F.lpad(text, width, F.lit("0"))).otherwise(text))).otherwise(out)
    return F.replace(out, F.lit("$$"), F.lit("$"))


def _base(outer: Column, urls: Column) -> Column:
    """The first BaseURL as seen from the base outside."""
    return resolve(outer, or_empty(F.try_element_at(urls, F.lit(1))))


def _kid(protections: Column) -> Column:
    """The first well-formed default KID."""
    hexes = F.transform(F.coalesce(protections, F.array().cast(_PROTECTION)), lambda p: F.replace(or_empty(p["_default_KID"]), F.lit("-"), F.lit("")))
    return F.try_element_at(F.filter(hexes, lambda x: x.rlike("^[0-9A-Fa-f]{32}$")), F.lit(1))


def representations(manifests: DataFrame, now: str | None = None) -> DataFrame:
    """One row per representation and period, with all that its segments need.

    ``now`` is the wall clock (UTC text) that live templates are cut by. Of live
    manifests only the first period counts.
    """
    doc = manifests.filter(is_dash(F.col("body"))).withColumn("d", F.from_xml("body", MPD, {"ignoreNamespace": "true"}))
    live = F.coalesce(F.col("d._type"), F.lit("")) == "dynamic"
    rows = doc.select(
        "manifest_id", "url", live.alias("live"), _base(F.col("url"), F.col("d.BaseURL")).alias("base"), iso_seconds(F.col("d._mediaPresentationDuration")).alias("mpd_dur"),
        iso_seconds(F.col("d._timeShiftBufferDepth")).alias("tsbd"), F.try_to_timestamp(F.col("d._availabilityStartTime")).alias("ast"), F.size("d.Period").alias("n_periods"),
        F.posexplode("d.Period").alias("period", "p"),
    ).filter(~F.col("live") | (F.col("period") == 0))
    given = iso_seconds(F.col("p._duration"))
    rows = rows.withColumn("base", _base(F.col("base"), F.col("p.BaseURL"))).withColumns({
        "period_dur": F.when((given == 0) & (F.col("n_periods") == 1), F.col("mpd_dur")).otherwise(given),
        "period_start": iso_seconds(F.col("p._start")),
    })
    rows = rows.select("*", F.posexplode("p.AdaptationSet").alias("ai", "s")).withColumn("base", _base(F.col("base"), F.col("s.BaseURL")))
    rows = rows.select("*", F.posexplode("s.Representation").alias("ri", "r")).withColumn("base", _base(F.col("base"), F.col("r.BaseURL")))
    both = lambda f: first_non_empty(F.col(f"r.{f}"), F.col(f"s.{f}"))
    field = lambda f: F.coalesce(F.nullif(F.col(f"r.SegmentTemplate.{f}"), F.lit("")), F.col(f"s.SegmentTemplate.{f}"))
    mime = first_non_empty(F.col("r._mimeType"), F.col("s._mimeType"), F.col("s._contentType"))
    codec = both("_codecs")
    timed = codec.startswith("stpp") | codec.startswith("wvtt")
    kind = (
        F.when(F.exists(F.coalesce("s.Role", F.array().cast(_VALUE)), lambda x: F.contains(or_empty(x["_value"]), F.lit("subtitle"))), F.lit("subtitles"))
        .when(mime.startswith("video"), F.lit("video"))
        .when(mime.startswith("audio"), F.lit("audio"))
        .when(mime.startswith("text") | mime.startswith("application/ttml") | timed, F.lit("subtitles"))
        .when(number(F.col("r._width"), "int") > 0, F.lit("video"))
        .otherwise(F.lit("unknown"))
    )
    locked = (F.coalesce(F.size("r.ContentProtection"), F.lit(0)) > 0) | (F.coalesce(F.size("s.ContentProtection"), F.lit(0)) > 0)
    rows = rows.withColumns({
        "track": F.concat_ws(".", first_non_empty(F.col("r._id"), F.lit("r")), F.col("ai").cast("string"), F.col("ri").cast("string")),
        "rep_id": or_empty(F.col("r._id")),
        "bandwidth": number(F.col("r._bandwidth")),
        "width": number(F.col("r._width"), "int"),
        "height": number(F.col("r._height"), "int"),
        "codecs": codec,
        "language": both("_lang"),
        "frame_rate": frame_rate(both("_frameRate")),
        "channels": or_empty(F.try_element_at(F.col("r.AudioChannelConfiguration"), F.lit(1))["_value"]),
        "media_type": kind,
        "kid": F.when(locked, F.unhex(F.coalesce(_kid(F.col("r.ContentProtection")), _kid(F.col("s.ContentProtection")), F.lit("0" * 32)))),
        "templated": F.col("r.SegmentTemplate").isNotNull() | F.col("s.SegmentTemplate").isNotNull(),
        "media": or_empty(field("_media")),
        "initialization": or_empty(field("_initialization")),
        "timescale": F.greatest(number(field("_timescale")), F.lit(1)),
        "duration": number(field("_duration")),
        "start_number": F.coalesce(field("_startNumber").try_cast("bigint"), F.lit(1)),
        "timeline": F.coalesce("r.SegmentTemplate.SegmentTimeline.S", "s.SegmentTemplate.SegmentTimeline.S"),
        "listed": F.coalesce("r.SegmentList", "s.SegmentList"),
        "now": F.lit(now).cast("timestamp"),
    })
    return rows.drop("p", "s", "r")


_ENTRY = "struct<time:bigint,dur:double,media:string,range:struct<start:bigint,end:bigint>>"


def _timeline() -> Column:
    """Entries of explicit times: the cursor runs on from the last given time; a negative repeat fills the period."""
    zero = F.lit(0).cast("bigint")
    end = F.floor(F.col("period_dur") * F.col("timescale")).cast("bigint")

    def step(a: Column, x: Column) -> Column:
        start = F.coalesce(x["_t"].try_cast("bigint"), a["next"])
        d, given = number(x["_d"]), number(x["_r"])
        fits = F.greatest(F.floor(F.try_divide(F.greatest(end - start, zero), d)).cast("bigint") - 1, zero)
        repeat = F.when(given >= 0, given).when((F.col("period_dur") > 0) & (d > 0), fits).otherwise(zero)
        entry = F.struct(start.alias("cur"), d.alias("d"), repeat.alias("rep"))
        return F.struct((start + (repeat + 1) * d).alias("next"), F.concat(a["out"], F.array(entry)).alias("out"))

    begin = F.struct(zero.alias("next"), F.array().cast("array<struct<cur:bigint,d:bigint,rep:bigint>>").alias("out"))
    runs = F.aggregate("timeline", begin, step, lambda a: a["out"])
    return F.flatten(F.transform(runs, lambda e: F.transform(F.sequence(zero, e["rep"]), lambda i: _entry(e["cur"] + i * e["d"], e["d"] / F.col("timescale")))))


def _entry(time: Column, dur: Column, media: Column | None = None, span: Column | None = None) -> Column:
    none = F.lit(None).cast("struct<start:bigint,end:bigint>")
    return F.struct(time.alias("time"), dur.alias("dur"), (F.lit("") if media is None else media).alias("media"), (none if span is None else span).alias("range"))


def _counted() -> tuple[Column, Column]:
    """Entries of equal durations, as many as fill the period or the time-shift window up to the wall clock; and how many went before."""
    zero = F.lit(0).cast("bigint")
    dur = F.col("duration") / F.col("timescale")
    window = F.when(F.col("tsbd") > 0, F.col("tsbd")).otherwise(F.lit(60.0))
    count = F.ceil(F.when(F.col("live"), window).otherwise(F.col("period_dur")) / dur).cast("bigint")
    elapsed = F.unix_timestamp("now") - F.unix_timestamp("ast") - F.col("period_start")
    ahead = F.when(F.col("live"), F.greatest(F.coalesce((elapsed / dur).cast("bigint") - count, zero), zero)).otherwise(zero)
    return F.when(count > 0, F.transform(F.sequence(zero, count - 1), lambda i: _entry(i * F.col("duration"), dur))).otherwise(F.array().cast(f"array<{_ENTRY}>")), ahead


def _segments(manifests: DataFrame, now: str | None) -> DataFrame:
    """Segments with stream_id and what is known of their track. Every manifest is parsed once: each track's entries are an array, whatever form it has."""
    rows = representations(manifests, now)
    zero = F.lit(0).cast("bigint")
    timed, counted = F.col("templated") & F.col("timeline").isNotNull(), F.col("templated") & F.col("timeline").isNull() & (F.col("duration") > 0)
    equal, ahead = _counted()
    list_dur = number(F.col("listed._duration")) / F.greatest(number(F.col("listed._timescale")), F.lit(1))
    listed = F.transform("listed.SegmentURL", lambda u: _entry(zero, list_dur, or_empty(u["_media"]), byte_span(u["_mediaRange"])))
    single = F.array(_entry(zero, F.col("period_dur")))
    entries = F.when(timed, _timeline()).when(counted, equal).when(F.col("templated"), F.array().cast(f"array<{_ENTRY}>")).when(F.col("listed").isNotNull(), listed).otherwise(single)
    rows = rows.withColumn("first_num", F.when(F.col("templated"), F.col("start_number") + F.when(counted, ahead).otherwise(zero)).otherwise(zero))
    rows = rows.select("*", F.posexplode(entries).alias("pos", "e")).withColumn("n", F.col("first_num") + F.col("pos"))
    fill = lambda template, num, time: expanded(F.col(template), F.col("rep_id"), F.col("bandwidth"), num, time)
    reference = F.when(F.col("templated"), fill("media", F.col("n"), F.col("e.time"))).otherwise(F.col("e.media"))
    start = F.col("listed.Initialization")
    init_ref = F.when(F.col("templated") & (F.col("initialization") != ""), fill("initialization", zero, zero)).when(~F.col("templated") & start.isNotNull(), or_empty(start["_sourceURL"]))
    init_span = F.when(~F.col("templated"), byte_span(start["_range"]))
    segs = rows.withColumns({"seg_url": resolve(F.col("base"), reference), "init_url": resolve(F.col("base"), init_ref)}).withColumns({
        "init": F.when(F.col("init_url").isNotNull(), F.struct(F.col("init_url").alias("url"), init_span.alias("range"))), "seg_dur": F.col("e.dur"), "range": F.col("e.range"), "seq": F.col("n"),
    })
    track = Window.partitionBy("manifest_id", "track").orderBy("period", "n")
    like = F.struct("codecs", "width", "height", F.col("init.url").alias("init"), "kid")
    segs = segs.withColumn("_first", F.first(F.struct("period", like.alias("like"))).over(track))
    same = F.col("_first.like").eqNullSafe(like)
    begins = F.col("period") > F.col("_first.period")
    return segs.withColumns({"stream_id": F.when(same, F.col("track")).otherwise(F.concat("track", F.lit(".p"), F.col("period").cast("string"))), "goes_on": same & begins})


def rejected(manifests: DataFrame) -> DataFrame:
    """manifest_id, period, track, reason: tracks whose template can't be counted out; they have no segments."""
    rows = representations(manifests).filter(F.col("templated") & F.col("timeline").isNull())
    no_length = ~F.col("live") & (F.col("period_dur") <= 0)
    reason = F.when(F.col("duration") <= 0, F.lit("template without timeline and duration")).when(no_length, F.lit("no length of the period to count segments to"))
    return rows.select("manifest_id", "period", "track", reason.alias("reason")).filter("reason IS NOT NULL")


def parse_segments(manifests: DataFrame, now: str | None = None) -> DataFrame:
    """Segments of all tracks, periods joined: manifest_id, stream_id, period, track, seg_ord, url, duration, range, kid, init, seq, discontinuity.

    A track that comes back in a later period with the same codecs, size, init
    URL and key as the first time goes on, with a discontinuity and running
    numbers; otherwise it is a track of its own, <id>.p<period>.
    """
    segs = _segments(manifests, now)
    stream = Window.partitionBy("manifest_id", "stream_id").orderBy("period", "n")
    seg_ord = (F.row_number().over(stream) - 1).cast("long")
    first_of_period = F.row_number().over(Window.partitionBy("manifest_id", "stream_id", "period").orderBy("n")) == 1
    return segs.select(
        "manifest_id", "stream_id", "period", "track", seg_ord.alias("seg_ord"), F.col("seg_url").alias("url"), F.col("seg_dur").alias("duration"), "range", "kid", "init",
        F.when(F.col("goes_on"), seg_ord).otherwise(F.col("seq")).alias("seq"), (F.col("goes_on") & first_of_period).alias("discontinuity"),
    )


_ABOUT = ("period", "ai", "ri", "url", "media_type", "bandwidth", "width", "height", "frame_rate", "codecs", "language", "channels", "live")


def streams(manifests: DataFrame, now: str | None = None) -> DataFrame:
    """Tracks as a catalog that ``select_streams`` takes, with n_segs and dur_s of their segments.

    A track that goes on over periods is one row, described as in its first period.
    """
    about = F.min_by(F.struct(*_ABOUT), F.struct("period", "n")).alias("a")
    rows = _segments(manifests, now).groupBy("manifest_id", "stream_id").agg(about, F.count(F.lit(1)).alias("n_segs"), F.sum("seg_dur").alias("dur_s")).select("manifest_id", "stream_id", "a.*", "n_segs", "dur_s")
    order = Window.partitionBy("manifest_id").orderBy("period", "ai", "ri")
    kind = F.col("media_type")
    return rows.select(
        "manifest_id", F.col("stream_id").alias("id"), (F.row_number().over(order) - 1).cast("long").alias("ord"), "media_type",
        F.when(kind == "video", 0).when(kind == "audio", 1).when(kind == "subtitles", 2).otherwise(3).alias("type_ord"), F.col("url").alias("playlist_url"),
        "bandwidth", "width", "height", "frame_rate", "codecs", "language", F.lit("").alias("name"), "channels", F.lit(False).alias("is_default"),
        F.lit("").alias("audio_group"), F.lit("").alias("subs_group"), F.lit("").alias("group_id"), F.lit(False).alias("muxed_audio"), "live", "n_segs", "dur_s",
    )
