"""From fetched bodies to one catalog, whatever kind they are of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dash, hls, pages


def kind_of(body: Column) -> Column:
    """hls, dash or page."""
    return F.when(hls.is_hls(body), F.lit("hls")).when(dash.is_dash(body), F.lit("dash")).otherwise(F.lit("page"))


def is_local(url: Column) -> Column:
    """Whether an address is a path on this machine or a file URL."""
    return ~url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://") | url.startswith("file://")


def base_of(url: Column) -> Column:
    """What references are resolved against: local paths as file URLs."""
    return F.when(is_local(url) & ~url.startswith("file://"), F.concat(F.lit("file://"), url)).otherwise(url)


def manifests(bodies: DataFrame, fetched: DataFrame) -> DataFrame:
    """manifest_id, url, body, kind: playlists and manifests of ``bodies`` (manifest_id, url, body).

    A page stands for the first link found in it or its frames, if ``fetched``
    (url, body) holds that and it is a playlist or manifest; else it goes.
    """
    rows = bodies.select("manifest_id", base_of(F.col("url")).alias("url"), "body").withColumn("kind", kind_of(F.col("body")))
    plain = rows.filter("kind <> 'page'")
    web = rows.filter("kind = 'page'").select(F.col("manifest_id").alias("page_id"), "url", F.col("body").alias("html"))
    known = fetched.select("url", F.col("body").alias("html"))
    first = pages.found_links(web, known).groupBy("page_id").agg(F.min_by("link", "place").alias("url"))
    found = first.join(fetched.select("url", "body"), "url").select(F.col("page_id").alias("manifest_id"), "url", "body").withColumn("kind", kind_of(F.col("body")))
    return plain.unionByName(found.filter("kind <> 'page'"))


def catalog(bodies: DataFrame, fetched: DataFrame, now: str | None = None) -> DataFrame:
    """The streams of all bodies as ``select_streams`` takes them."""
    rows = manifests(bodies, fetched)
    of_hls = hls.parse_masters(rows.filter("kind = 'hls'"))
    of_dash = dash.streams(rows.filter("kind = 'dash'"), now)
    return of_hls.unionByName(of_dash, allowMissingColumns=True)


def refreshed(known: DataFrame, snapshots: DataFrame, now: str | None = None, kinds: tuple[str, ...] = ("hls", "dash")) -> DataFrame:
    """Segments of the known streams (manifest_id, id) after a refresh, with ``lost`` rows for those that the new manifest lacks.

    ``snapshots`` (manifest_id, url, body) are the bodies as fetched again. HLS
    playlists are their stream; tracks of a DASH manifest are matched by id.
    ``kinds``: those that can be among them, which spares the plan of the other.
    """
    rows = snapshots.withColumn("kind", kind_of(F.col("body")))
    found = []
    if "hls" in kinds:
        playlist = hls.parse_media(rows.filter("kind = 'hls'")).withColumnRenamed("stream_id", "manifest_id")
        found.append(known.select("manifest_id", "id").join(playlist.select("manifest_id", "seg_ord", "url", "duration", "range"), "manifest_id"))
    if "dash" in kinds:
        tracks = dash.parse_segments(rows.filter("kind = 'dash'"), now).withColumnRenamed("stream_id", "id")
        found.append(known.select("manifest_id", "id").join(tracks.select("manifest_id", "id", "seg_ord", "url", "duration", "range"), ["manifest_id", "id"]))
    if not found:
        return known.select("manifest_id", "id", *[F.lit(None).cast(t).alias(c) for c, t in (("seg_ord", "long"), ("url", "string"), ("duration", "double"), ("range", "struct<start:bigint,end:bigint>"))], F.lit(True).alias("lost"))
    both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    both = both.withColumn("lost", F.lit(False))
    gone = known.select("manifest_id", "id").join(both.select("manifest_id", "id").distinct(), ["manifest_id", "id"], "left_anti").withColumn("lost", F.lit(True))
    return both.unionByName(gone, allowMissingColumns=True)
