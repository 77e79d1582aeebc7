"""The selector language: parsed on the driver, compiled into column expressions.

    expr   := "" | "none" | take | part (":" part)*
    take   := ("best" | "worst" | "all") digits?
    part   := "for=" take | key ["!"] "=" value

Keys id, lang, name, codecs, res, range, channel take a regular expression that is
searched without regard to case ("!" keeps what doesn't match); bwmin and bwmax
take kbit/s; segsmin, segsmax a count; plistdurmin, plistdurmax seconds or a
duration like 1h30m. Parts are all to hold. A selector without "for" takes all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import resolution


class SelectorError(ValueError):
    """A selector that can't be read."""


@dataclass(frozen=True)
class Part:
    key: str
    value: str | float
    negated: bool = False


@dataclass(frozen=True)
class Selector:
    take: str = "all"
    n: int = 1
    parts: tuple[Part, ...] = ()
    nothing: bool = False


_TAKE = re.compile(r"(best|worst|all)(\d*)")
_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
TEXT_KEYS = ("id", "lang", "name", "codecs", "res", "range", "channel")


def duration(text: str) -> float:
    """Seconds of a number or of a duration such as 90, 20m or 1h30m."""
    try:
        return float(text)
    except ValueError:
        pass
    found = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)", text.lstrip("+-"))
    if not found or "".join(a + b for a, b in found) != text.lstrip("+-"):
        raise SelectorError(f"{text!r} is no length of time")
    return (-1 if text.startswith("-") else 1) * sum(float(a) * _UNITS[b] for a, b in found)


def _take(text: str) -> tuple[str, int] | None:
    m = _TAKE.fullmatch(text)
    return m and (m[1], int(m[2]) if m[2] else 1)


def parse(text: str) -> Selector:
    text = text.strip()
    if text in ("", "none"):
        return Selector(nothing=True)
    if found := _take(text):
        return Selector(*found)
    take, parts = ("all", 1), []
    for item in text.split(":"):
        key, equals, value = item.partition("=")
        if not equals:
            raise SelectorError(f"{item!r} has no value: a part is written key=value")
        key, value = key.strip().lower(), value.strip()
        negated = key.endswith("!")
        key = key.removesuffix("!")
        try:
            if key == "for":
                take = _take(value)
                if not take:
                    raise ValueError(value)
            elif key in ("bwmin", "bwmax"):
                parts.append(Part(key, int(value) * 1000.0))
            elif key in ("segsmin", "segsmax"):
                parts.append(Part(key, float(int(value))))
            elif key in ("plistdurmin", "plistdurmax"):
                parts.append(Part(key, duration(value)))
            elif key in TEXT_KEYS:
                re.compile(value)
                parts.append(Part(key, value, negated))
            else:
                raise SelectorError(f"streams have no property {key!r}")
        except SelectorError:
            raise
        except (ValueError, re.error) as e:
            raise SelectorError(f"{key} can't be {value!r}") from e
    return Selector(*take, tuple(parts))


def checked(selectors: DataFrame, column: str = "selector") -> DataFrame:
    """Rows with what their selector says: ok, take (nothing, best, worst or all), n, parts (conditions), error. A null one can't be read."""
    kept = selectors.drop("ok", "take", "n", "parts", "error")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text in frame[column]:
                try:
                    if text is None:
                        raise SelectorError("no selector")
                    found = parse(text)
                    out.append((True, "nothing" if found.nothing else found.take, found.n, len(found.parts), ""))
                except SelectorError as e:
                    out.append((False, "", 0, 0, str(e)))
            yield frame.assign(**dict(zip(("ok", "take", "n", "parts", "error"), map(list, zip(*out, strict=True)), strict=True))) if out else frame.assign(ok=[], take=[], n=[], parts=[], error=[])

    added = [T.StructField(c, t) for c, t in (("ok", T.BooleanType()), ("take", T.StringType()), ("n", T.IntegerType()), ("parts", T.IntegerType()), ("error", T.StringType()))]
    return kept.mapInPandas(read, T.StructType([*kept.schema.fields, *added]))


def condition(selector: Selector) -> Column:
    """The rows of a streams table that a selector's parts let through.

    The table needs n_segs and dur_s (0 where unknown, which passes) only if the
    selector asks for them. ``range`` is looked for in an empty text.
    """
    texts = {"id": F.col("id"), "lang": F.col("language"), "name": F.col("name"), "codecs": F.col("codecs"), "channel": F.col("channels"), "range": F.lit("")}
    out = F.lit(True)
    for p in selector.parts:
        if p.key in TEXT_KEYS:
            value = resolution(F.col("width"), F.col("height")) if p.key == "res" else texts[p.key]
            found = value.rlike(f"(?i){p.value}")
            out &= ~found if p.negated else found
        elif p.key.startswith("bw"):
            out &= F.col("bandwidth") >= p.value if p.key == "bwmin" else F.col("bandwidth") <= p.value
        else:
            known = F.col("n_segs" if p.key.startswith("segs") else "dur_s")
            out &= (known == 0) | (known >= p.value if p.key.endswith("min") else known <= p.value)
    return out


def listing_order() -> list[Column]:
    """Types in turn; videos by height, audio by default flag and channels; then bandwidth, then manifest order."""
    video, audio = F.col("media_type") == "video", F.col("media_type") == "audio"
    return [
        F.col("type_ord"),
        F.when(video, -F.col("height")).otherwise(F.lit(0)),
        F.when(audio & F.col("is_default"), F.lit(0)).otherwise(F.lit(1)),
        F.when(audio, -F.coalesce(F.col("channels").try_cast("double"), F.lit(0.0))).otherwise(F.lit(0.0)),
        F.col("bandwidth").desc(),
        F.col("ord"),
    ]


def ranked(streams: DataFrame) -> DataFrame:
    """``rank`` from 1 within each manifest and type."""
    return streams.withColumn("rank", F.row_number().over(Window.partitionBy("manifest_id", "media_type").orderBy(*listing_order())))


def applied(pool: DataFrame, selector: Selector) -> DataFrame:
    """What a selector takes of each manifest's ranked streams of one type."""
    if selector.nothing:
        return pool.limit(0)
    hits = pool.filter(condition(selector))
    if selector.take == "all":
        return hits
    order = F.col("rank") if selector.take == "best" else F.col("rank").desc()
    place = F.row_number().over(Window.partitionBy("manifest_id", "media_type").orderBy(order))
    return hits.withColumn("_place", place).filter(F.col("_place") <= selector.n).drop("_place")


def select_streams(streams: DataFrame, video: str = "best", audio: str | None = None, subs: str | None = None) -> DataFrame:
    """The streams chosen in each manifest, with ``pick`` from 1 in output order.

    If exactly one video is chosen and it names a rendition group that has
    members, audio (or subtitles) come from that group only. Without an audio
    selector: the best rendition per language; if there are none, nothing when
    all chosen videos carry audio, else the first audio-only variant. Without a
    subtitle selector: all subtitles.
    """
    rows = ranked(streams)
    videos = applied(rows.filter(F.col("media_type") == "video"), parse(video))
    about = videos.groupBy("manifest_id").agg(
        F.count(F.lit(1)).alias("n_videos"), F.max("audio_group").alias("want_audio"), F.max("subs_group").alias("want_subs"), F.bool_and("muxed_audio").alias("all_muxed")
    )

    def pool(kind: str, wanted: str) -> DataFrame:
        of_kind = rows.filter(F.col("media_type") == kind).join(about, "manifest_id", "left")
        asked = (F.coalesce("n_videos", F.lit(0)) == 1) & (F.coalesce(F.col(wanted), F.lit("")) != "")
        inside = F.coalesce(asked & (F.col("group_id") == F.col(wanted)), F.lit(False))
        hits = of_kind.withColumn("_in", inside).withColumn("_any", F.bool_or("_in").over(Window.partitionBy("manifest_id")))
        return hits.filter(F.col("_in") | ~F.col("_any"))

    sounds = pool("audio", "want_audio")
    if audio is None:
        here = Window.partitionBy("manifest_id")
        rendition = F.col("group_id") != ""
        sounds = (
            sounds.withColumn("_renditions", F.bool_or(rendition).over(here))
            .withColumn("_first", F.row_number().over(Window.partitionBy("manifest_id", rendition, F.when(rendition, F.col("language")).otherwise(F.lit(""))).orderBy("rank")) == 1)
            .filter(F.col("_first") & F.when(F.col("_renditions"), rendition).otherwise(~F.coalesce("all_muxed", F.lit(False))))
        )
    else:
        sounds = applied(sounds, parse(audio))
    texts = pool("subtitles", "want_subs")
    if subs is not None:
        texts = applied(texts, parse(subs))
    columns = [*streams.columns, "rank"]
    out = videos.select(columns).unionByName(sounds.select(columns)).unionByName(texts.select(columns))
    return out.withColumn("pick", F.row_number().over(Window.partitionBy("manifest_id").orderBy("type_ord", "rank")))


def listed(streams: DataFrame) -> DataFrame:
    """Streams in listing order with a one-line summary."""
    kbps = F.when(F.col("bandwidth") > 0, F.concat((F.floor(F.col("bandwidth") / 1000)).cast("bigint").cast("string"), F.lit("kbps")))
    text = lambda c: F.nullif(c, F.lit(""))
    line = F.concat_ws(" ", F.col("id"), F.col("media_type"), text(resolution(F.col("width"), F.col("height"))), kbps, text(F.col("codecs")), text(F.col("language")), text(F.col("name")))
    return ranked(streams).withColumn("summary", line)
