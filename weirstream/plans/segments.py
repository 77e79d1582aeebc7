"""Planning what to fetch: dedupe, filters, init rows, ordinals, commit points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fetch_key() -> Column:
    """URL and byte range, which together name a piece."""
    span = F.when(F.col("range").isNotNull(), F.concat(F.lit("@"), F.col("range")["start"].cast("string"), F.lit("-"), F.col("range")["end"].cast("string")))
    return F.concat(F.col("url"), F.coalesce(span, F.lit("")))


def deduplicated(segments: DataFrame) -> DataFrame:
    """The first segment of each stream, URL and range; repeated URLs go also in complete playlists."""
    first = F.row_number().over(Window.partitionBy("stream_id", fetch_key()).orderBy("seg_ord"))
    return segments.withColumn("_n", first).filter("_n = 1").drop("_n")


def without_ads(segments: DataFrame, patterns: list[str]) -> DataFrame:
    """Segments whose URL none of the patterns is found in (case counts)."""
    hit = F.lit(False)
    for p in patterns:
        hit |= F.col("url").rlike(p)
    return segments.filter(~hit)


def live_edge(segments: DataFrame, keep: int = 3) -> DataFrame:
    """The newest segments of each stream."""
    place = F.row_number().over(Window.partitionBy("stream_id").orderBy(F.col("seg_ord").desc()))
    return segments.withColumn("_n", place).filter(F.col("_n") <= keep).drop("_n")


def planned(segments: DataFrame) -> DataFrame:
    """Rows to fetch in order: stream_id, idx (from 0), is_init, seg_ord, url.

    An init row goes before a segment whose init URL differs from the last one
    that any earlier segment had; segments without init don't forget it. Only
    URLs are compared, not ranges.
    """
    before = Window.partitionBy("stream_id").orderBy("seg_ord").rowsBetween(Window.unboundedPreceding, -1)
    init = F.col("init")["url"]
    changed = init.isNotNull() & ~init.eqNullSafe(F.last(init, ignorenulls=True).over(before))
    own = F.struct(F.lit(False).alias("is_init"), F.col("url"))
    rows = segments.withColumn("_changed", changed).select(
        "stream_id", "seg_ord", F.explode(F.when(F.col("_changed"), F.array(F.struct(F.lit(True).alias("is_init"), init.alias("url")), own)).otherwise(F.array(own))).alias("r")
    )
    order = Window.partitionBy("stream_id").orderBy("seg_ord", F.col("r.is_init").desc())
    return rows.select("stream_id", (F.row_number().over(order) - 1).cast("long").alias("idx"), "r.is_init", "seg_ord", "r.url")


def committed(outcomes: DataFrame, live: bool = False) -> DataFrame:
    """Outcomes (stream_id, idx, ok) that are committed: those before the stream's first failure or gap.

    In live streams failures are holes that don't hold up what follows.
    """
    if live:
        return outcomes.filter("ok")
    order = Window.partitionBy("stream_id").orderBy("idx")
    broken = (~F.col("ok")) | (F.col("idx") != F.row_number().over(order) - 1)
    stop = F.max(F.col("_broken").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return outcomes.withColumn("_broken", broken).withColumn("_stop", stop).filter("_stop = 0").drop("_broken", "_stop")


def pending(plan: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Rows of a plan from each stream's checkpoint (stream_id, next_idx) on."""
    return plan.join(checkpoints, "stream_id", "left").filter(F.col("idx") >= F.coalesce("next_idx", F.lit(0))).drop("next_idx")


def resume_points(states: DataFrame) -> DataFrame:
    """next_idx and offset of JSON resume states (stream_id, state, file_bytes); files shorter than the offset start over."""
    parsed = states.withColumn("_s", F.from_json("state", "next_idx bigint, offset bigint"))
    good = F.coalesce((F.col("_s.offset") <= F.col("file_bytes")) & F.col("_s.next_idx").isNotNull(), F.lit(False))
    return parsed.select("stream_id", *[F.when(good, F.col(f"_s.{c}")).otherwise(F.lit(0)).cast("long").alias(c) for c in ("next_idx", "offset")])
