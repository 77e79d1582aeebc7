"""HLS playlists as tables.

Playlists come as rows (manifest_id, url, body). Lines are numbered, classified
and numbered again by the URI line that ends their segment; keys, init maps and
byte ranges follow from windows over one playlist's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import AUDIO_CODECS, VIDEO_CODECS, has_codec
from ..functions.urls import resolve
from ..schemas import number, or_empty

# Key formats of DRM systems, whatever the method says.
DRM_FORMATS = ("urn:uuid:edef8ba9", "urn:uuid:9a04f079")
APPLE_FORMAT = "com.apple.streamingkeydelivery"

#: NAME=value, where a quoted value may hold commas and an open quote takes the rest.
_ATTRIBUTE = r'\s*([^=,]+)=("[^"]*(?:"|$)|[^,]*)'


def is_hls(body: Column) -> Column:
    start = F.regexp_replace(F.substr(body, F.lit(1), F.lit(64)), "^[﻿\\s]+", "")
    return start.startswith("#EXTM3U")


def attributes(text: Column) -> Column:
    """map<string,string> of an attribute list: names in upper case, quotes gone, the last of repeated names."""
    names = F.transform(F.regexp_extract_all(text, F.lit(_ATTRIBUTE), 1), lambda x: F.upper(F.trim(x)))
    values = F.transform(F.regexp_extract_all(text, F.lit(_ATTRIBUTE), 2), lambda x: F.regexp_replace(F.trim(x), '^"|"$', ""))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), lambda n: n == x["k"]))
    return F.map_from_entries(last)


def _at(attrs: str, name: str) -> Column:
    return or_empty(F.try_element_at(F.col(attrs), F.lit(name)))


def lines_of(playlists: DataFrame) -> DataFrame:
    """manifest_id, url, line_no, line: trimmed lines of HLS playlists."""
    rows = playlists.filter(F.contains("body", F.lit("#EXTM3U")))
    rows = rows.select("manifest_id", F.col("url").alias("base"), F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    return rows.withColumn("line", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")))


def _after(tag: str) -> Column:
    return F.substr(F.col("line"), F.lit(len(tag) + 1))


def _has(tag: str) -> Column:
    return F.col("line").startswith(tag)


def _is_uri() -> Column:
    return (F.col("line") != "") & ~_has("#")


def is_master(body: Column) -> Column:
    return F.contains(body, F.lit("#EXT-X-STREAM-INF")) | F.contains(body, F.lit("#EXT-X-MEDIA:"))


def parse_masters(playlists: DataFrame) -> DataFrame:
    """Streams that master playlists list; ids v#, a#, s# count within a playlist.

    A variant is closed by the next URI line; of several before it only the last
    counts, but all use up a number. Average bandwidth goes before peak. Variants
    without a size whose codecs have no video are audio. Renditions without URI
    and closed captions are left out. A media playlist on its own is the one
    video v1.
    """
    inf, media = "#EXT-X-STREAM-INF:", "#EXT-X-MEDIA:"
    rows = lines_of(playlists.filter(is_master(F.col("body"))))
    order = Window.partitionBy("manifest_id").orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("a", F.when(_has(inf), attributes(_after(inf))).when(_has(media), attributes(_after(media))))
    kept = _has(media) & (_at("a", "URI") != "") & (_at("a", "TYPE") != "CLOSED-CAPTIONS")
    rows = rows.withColumns({
        "uri_no": F.coalesce(F.count_if(_is_uri()).over(before), F.lit(0)),
        "v": F.count_if(_has(inf)).over(order),
        "a_no": F.count_if(kept & (_at("a", "TYPE") == "AUDIO")).over(order),
        "s_no": F.count_if(kept & (_at("a", "TYPE") == "SUBTITLES")).over(order),
        "kept": kept,
    })
    group = Window.partitionBy("manifest_id", "uri_no").orderBy("line_no")
    rows = rows.withColumn("inf", F.last(F.when(_has(inf), F.struct("a", "v")), ignorenulls=True).over(group))
    size = lambda n: number(F.regexp_extract(_at("a", "RESOLUTION"), r"^\s*(\d+)(?:x(\d+))?", n), "int")
    variants = rows.filter(_is_uri() & F.col("inf").isNotNull()).select("manifest_id", "base", "line_no", F.col("line").alias("uri"), F.col("inf.a").alias("a"), F.concat(F.lit("v"), F.col("inf.v")).alias("id"))
    average = number(_at("a", "AVERAGE-BANDWIDTH"))
    audio_only = (size(1) == 0) & (_at("a", "CODECS") != "") & ~has_codec(_at("a", "CODECS"), VIDEO_CODECS)
    variants = variants.select(
        "manifest_id", "base", "line_no", "uri", "id",
        F.when(audio_only, F.lit("audio")).otherwise(F.lit("video")).alias("media_type"),
        F.when(average != 0, average).otherwise(number(_at("a", "BANDWIDTH"))).alias("bandwidth"),
        size(1).alias("width"), size(2).alias("height"), number(_at("a", "FRAME-RATE"), "double").alias("frame_rate"),
        _at("a", "CODECS").alias("codecs"), F.lit("").alias("language"), F.lit("").alias("name"), F.lit("").alias("channels"), F.lit(False).alias("is_default"),
        _at("a", "AUDIO").alias("audio_group"), _at("a", "SUBTITLES").alias("subs_group"), F.lit("").alias("group_id"),
        (~audio_only & has_codec(_at("a", "CODECS"), AUDIO_CODECS)).alias("muxed_audio"),
    )
    sound = _at("a", "TYPE") == "AUDIO"
    renditions = rows.filter("kept").filter(_at("a", "TYPE").isin("AUDIO", "SUBTITLES")).select(
        "manifest_id", "base", "line_no", _at("a", "URI").alias("uri"), F.when(sound, F.concat(F.lit("a"), "a_no")).otherwise(F.concat(F.lit("s"), "s_no")).alias("id"),
        F.when(sound, F.lit("audio")).otherwise(F.lit("subtitles")).alias("media_type"),
        F.lit(0).cast("bigint").alias("bandwidth"), F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit(0.0).alias("frame_rate"),
        F.lit("").alias("codecs"), _at("a", "LANGUAGE").alias("language"), _at("a", "NAME").alias("name"), _at("a", "CHANNELS").alias("channels"), (_at("a", "DEFAULT") == "YES").alias("is_default"),
        F.lit("").alias("audio_group"), F.lit("").alias("subs_group"), _at("a", "GROUP-ID").alias("group_id"), F.lit(False).alias("muxed_audio"),
    )
    bare = playlists.filter(~is_master(F.col("body")) & F.contains("body", F.lit("#EXTM3U"))).select("manifest_id", F.col("url").alias("base"))
    empty = dict.fromkeys(("codecs", "language", "name", "channels", "audio_group", "subs_group", "group_id"), F.lit(""))
    zero = {"bandwidth": F.lit(0).cast("bigint"), "width": F.lit(0), "height": F.lit(0), "frame_rate": F.lit(0.0), "is_default": F.lit(False), "muxed_audio": F.lit(False)}
    alone = bare.select("manifest_id", "base", F.lit(0).alias("line_no"), F.col("base").alias("uri"), F.lit("v1").alias("id"), F.lit("video").alias("media_type"), *[c.alias(n) for n, c in (empty | zero).items()])
    both = variants.unionByName(renditions).unionByName(alone)
    type_ord = F.when(F.col("media_type") == "video", 0).when(F.col("media_type") == "audio", 1).otherwise(2)
    return both.select(
        "manifest_id", "id", (F.row_number().over(order) - 1).cast("long").alias("ord"), "media_type", type_ord.alias("type_ord"), resolve(F.col("base"), F.col("uri")).alias("playlist_url"),
        *[c for c in both.columns[6:]],
    )


def bad_iv(text: Column) -> Column:
    """Whether an IV that is given isn't whole bytes in hexadecimal."""
    return (text != "") & ~text.rlike("^(?:[0-9A-Fa-f]{2})+$")


def rejected(playlists: DataFrame) -> DataFrame:
    """manifest_id, line_no, reason: key lines that make a playlist unusable; ``parse_media`` gives no segments for it."""
    rows = lines_of(playlists).filter(_has("#EXT-X-KEY:")).withColumn("a", attributes(_after("#EXT-X-KEY:")))
    iv = F.regexp_replace(_at("a", "IV"), "^0[xX]", "")
    return rows.filter(bad_iv(iv) & (_at("a", "METHOD") != "NONE")).select("manifest_id", "line_no", F.concat(F.lit("bad IV "), iv).alias("reason"))


def parse_media(playlists: DataFrame) -> DataFrame:
    """Segments of media playlists (see ``schemas.SEGMENTS``, stream_id is the manifest_id).

    A segment is its URI line with the tags since the URI before. The last of
    repeated tags counts. Keys and init maps hold until they are replaced; a key
    of method NONE ends one. A byte range without offset goes on where the one
    before ended, unless a segment without range lies between. A playlist with an
    IV that isn't hexadecimal has no segments (see ``rejected``).
    """
    rows = lines_of(playlists.filter(~is_master(F.col("body"))))
    order = Window.partitionBy("manifest_id").orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    key, init, inf, span, first = "#EXT-X-KEY:", "#EXT-X-MAP:", "#EXTINF:", "#EXT-X-BYTERANGE:", "#EXT-X-MEDIA-SEQUENCE:"
    rows = rows.withColumn("no", F.coalesce(F.count_if(_is_uri()).over(before), F.lit(0)))
    rows = rows.withColumn("a", F.when(_has(key), attributes(_after(key))).when(_has(init), attributes(_after(init))))
    method, form, uri = _at("a", "METHOD"), _at("a", "KEYFORMAT"), _at("a", "URI")
    drm = F.contains(form, F.lit(DRM_FORMATS[0])) | F.contains(form, F.lit(DRM_FORMATS[1])) | (form == APPLE_FORMAT) | uri.startswith("skd://")
    name = F.when(drm, F.lit("CENC")).when(method.startswith("SAMPLE-AES"), F.lit("SAMPLE-AES")).otherwise(method)
    iv = F.regexp_replace(_at("a", "IV"), "^0[xX]", "")
    rows = rows.withColumns({
        # NONE is a value too, so that it replaces the key before
        "key": F.when(_has(key), F.struct(name.alias("method"), F.when(drm, F.lit("")).otherwise(uri).alias("uri"), F.when(iv != "", F.unhex(iv)).alias("iv"), (method == "NONE").alias("none"), ((method != "NONE") & bad_iv(iv)).alias("bad"))),
        "init": F.when(_has(init), F.struct(uri.alias("uri"), F.nullif(_at("a", "BYTERANGE"), F.lit("")).alias("span"))),
    })
    last = lambda c, w=order: F.last(c, ignorenulls=True).over(w)
    group = Window.partitionBy("manifest_id", "no").orderBy("line_no")
    whole = Window.partitionBy("manifest_id")
    rows = rows.withColumns({
        "cur_key": last("key"),
        "cur_init": last("init"),
        "stream_init": F.max_by("init", F.when(F.col("init").isNotNull(), F.col("line_no"))).over(whole),
        "dur": last(F.when(_has(inf), number(F.regexp_extract(_after(inf), "^([^,]*)", 1), "double")), group),
        "span": last(F.when(_has(span), _after(span)), group),
        "disc": F.bool_or(F.col("line") == "#EXT-X-DISCONTINUITY").over(group),
        "seq0": F.coalesce(last(F.when(_has(first), number(_after(first)))), F.lit(0)),
    })
    segs = rows.withColumn("rejected", F.coalesce(F.bool_or("key.bad").over(whole), F.lit(False))).filter(_is_uri() & ~F.col("rejected"))
    length = number(F.split_part("span", F.lit("@"), F.lit(1)))
    offset = F.when(F.contains("span", F.lit("@")), number(F.split_part("span", F.lit("@"), F.lit(2))))
    # a chain begins at an offset, at a segment without range, and after one
    starts = F.col("span").isNull() | offset.isNotNull()
    segs = segs.withColumns({"length": length, "offset": offset, "chain": F.sum(starts.cast("int")).over(order)})
    chain = Window.partitionBy("manifest_id", "chain").orderBy("line_no")
    start = F.coalesce(F.first("offset").over(chain), F.lit(0)) + F.coalesce(F.sum("length").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    segs = segs.withColumn("start", start)
    given = F.coalesce("cur_init", "stream_init")
    init_start = F.when(F.contains(given["span"], F.lit("@")), number(F.split_part(given["span"], F.lit("@"), F.lit(2)))).otherwise(F.lit(0))
    init_length = number(F.split_part(given["span"], F.lit("@"), F.lit(1)))
    init_range = F.when(given["span"].isNotNull(), F.struct(init_start.alias("start"), (init_start + init_length - 1).alias("end")))
    keyed = F.col("cur_key").isNotNull() & ~F.col("cur_key.none")
    key_uri = F.when((F.col("cur_key.uri") == "") | F.col("cur_key.uri").startswith("data:"), F.col("cur_key.uri")).otherwise(resolve(F.col("base"), F.col("cur_key.uri")))
    return segs.select(
        F.col("manifest_id").alias("stream_id"),
        F.col("no").cast("long").alias("seg_ord"),
        resolve(F.col("base"), F.col("line")).alias("url"),
        F.coalesce("dur", F.lit(0.0)).alias("duration"),
        F.when(F.col("span").isNotNull(), F.struct(F.col("start"), (F.col("start") + F.col("length") - 1).alias("end"))).alias("range"),
        F.when(keyed, F.struct(F.col("cur_key.method").alias("method"), key_uri.alias("uri"), F.col("cur_key.iv").alias("iv"), F.lit(None).cast("binary").alias("kid"))).alias("key"),
        F.when(given.isNotNull(), F.struct(resolve(F.col("base"), given["uri"]).alias("url"), init_range.alias("range"))).alias("init"),
        (F.col("seq0") + F.col("no")).cast("long").alias("seq"),
        F.coalesce("disc", F.lit(False)).alias("discontinuity"),
    )


def media_info(playlists: DataFrame) -> DataFrame:
    """manifest_id, live, media_seq, target_dur, refresh_s of media playlists.

    Live until an end mark or the type VOD; refresh is half the target duration.
    """
    rows = lines_of(playlists.filter(~is_master(F.col("body"))))
    last = lambda tag, kind: F.coalesce(F.max_by(F.when(_has(tag), number(_after(tag), kind)), F.when(_has(tag), F.col("line_no"))), F.lit(0).cast(kind))
    ended = (F.col("line") == "#EXT-X-ENDLIST") | (_has("#EXT-X-PLAYLIST-TYPE:") & (F.trim(_after("#EXT-X-PLAYLIST-TYPE:")) == "VOD"))
    out = rows.groupBy("manifest_id").agg((~F.bool_or(ended)).alias("live"), last("#EXT-X-MEDIA-SEQUENCE:", "bigint").alias("media_seq"), last("#EXT-X-TARGETDURATION:", "double").alias("target_dur"))
    return out.withColumn("refresh_s", F.when(F.col("live"), F.col("target_dur") / 2).otherwise(F.lit(0.0)))
