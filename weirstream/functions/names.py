"""Names of tracks and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import first_non_empty, or_empty

DEFAULT_NAME = "stream-output"


def clean(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\w.\-]+", "_")


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def track_ids(streams: DataFrame) -> DataFrame:
    """``track_id`` for each stream of a manifest: video, video2, audio-fr, sub-de, ...; numbered in the order of ``ord``."""
    kind = F.when(F.col("media_type") == "subtitles", F.lit("sub")).otherwise(F.col("media_type"))
    tagged = (F.col("media_type") != "video") & (F.col("language") != "")
    base = F.when(tagged, F.concat(kind, F.lit("-"), clean(F.col("language")))).otherwise(kind)
    n = F.row_number().over(Window.partitionBy("manifest_id", "_base").orderBy("ord"))
    rows = streams.withColumn("_base", base).withColumn("_n", n)
    return rows.withColumn("track_id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.col("_n").cast("string")))).drop("_base", "_n")


def raw_extension(media_type: Column, first_url: Column, has_init: Column) -> Column:
    mp4 = has_init | F.contains(or_empty(first_url), F.lit(".m4s")) | F.contains(or_empty(first_url), F.lit(".mp4"))
    return F.when(media_type == "subtitles", F.lit(".rawsub")).when(mp4, F.lit(".mp4")).otherwise(F.lit(".ts"))


def output_path(out: Column, url: Column, live: Column, stamp: Column) -> Column:
    """The path asked for, with an extension; else one from the URL's last part, with ``stamp`` for live streams."""
    given = F.when(out.rlike(r"\.[^./]*$"), out).otherwise(F.concat(out, F.lit(".mp4")))
    last = without_extension(F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), r"^[a-z]+://[^/]*/(?:.*/)?([^/]+)/?$", 1))
    name = F.substring(F.when(last.isin("", "."), F.lit(DEFAULT_NAME)).otherwise(last), 1, 120)
    return F.when(or_empty(out) != "", given).otherwise(F.concat(name, F.when(live, F.concat(F.lit("-"), stamp)).otherwise(F.lit("")), F.lit(".mp4")))


def sidecars(subtitles: DataFrame, form: str = "srt") -> DataFrame:
    """``path`` of each subtitle file (out, id, ord, language, name): <out>.<language>.<form>; later ones of a language have their name in it."""
    tag = first_non_empty(F.col("language"), F.lit("sub"))
    n = F.row_number().over(Window.partitionBy("out", tag).orderBy("ord"))
    base = F.concat(without_extension(F.col("out")), F.lit("."), tag)
    more = F.concat(F.lit("."), clean(first_non_empty(F.col("name"), F.col("id"))))
    return subtitles.withColumn("path", F.concat(base, F.when(n == 1, F.lit("")).otherwise(more), F.lit(f".{form}")))


def subtitle_codec(extension: Column) -> Column:
    return F.when(extension.isin(".mp4", ".m4v", ".mov"), F.lit("mov_text")).when(extension == ".mkv", F.lit("srt")).when(extension == ".webm", F.lit("webvtt")).otherwise(F.lit(""))


def segment_mime(name: Column) -> Column:
    return F.when(name.endswith(".ts"), F.lit("video/mp2t")).otherwise(F.lit("video/mp4"))


def stream_format(text: Column) -> Column:
    """The format asked for in lower case; hls if none was."""
    return F.when(F.trim(or_empty(text)) == "", F.lit("hls")).otherwise(F.lower(F.trim(text)))


def display_name(name: Column, language: Column, track_id: Column) -> Column:
    """What a rendition is called in a playlist: its name, else its language, else its id."""
    return first_non_empty(name, language, track_id)


def refresh_seconds(target: Column, minimum: Column, depth: Column) -> Column:
    """How often to look again: half the target duration; for manifests the minimum update period, else half the depth, 2 s at least; else 4 s."""
    dash = F.when(minimum > 0, minimum).when(depth > 0, F.greatest(depth / 2, F.lit(2.0)))
    return F.coalesce(F.when(target > 0, target / 2), dash, F.lit(4.0))
