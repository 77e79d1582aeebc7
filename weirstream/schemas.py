"""Schemas of the catalog tables, and helpers for their zero values.

Missing values in string columns are ``''`` and unknown numbers are 0, never
null; ranges, keys and init maps are null when absent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = "struct<start:bigint,end:bigint>"
KEY = "struct<method:string,uri:string,iv:binary,kid:binary>"
INIT = f"struct<url:string,range:{RANGE}>"

MANIFESTS = "manifest_id string, url string, body string"
STREAMS = (
    "manifest_id string, id string, ord long, media_type string, type_ord int, playlist_url string, bandwidth long, width int, height int,"
    " frame_rate double, codecs string, language string, name string, channels string, is_default boolean, audio_group string,"
    " subs_group string, group_id string, muxed_audio boolean, live boolean, media_seq long, target_dur double, refresh_s double,"
    f" init {INIT}, segments_full boolean"
)
SEGMENTS = f"stream_id string, seg_ord long, url string, duration double, range {RANGE}, key {KEY}, init {INIT}, seq long, discontinuity boolean"
CUES = "track_id string, cue_ord long, start double, end double, text string"

#: Media types in the order that listings have them.
MEDIA_TYPES = ("video", "audio", "subtitles", "unknown")


def number(text: Column, kind: str = "bigint") -> Column:
    """A number, or 0 for what isn't one."""
    return F.coalesce(F.trim(text).try_cast(kind), F.lit(0).cast(kind))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def first_non_empty(*texts: Column) -> Column:
    """The first text that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))
