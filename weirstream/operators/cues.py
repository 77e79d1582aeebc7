"""Subtitle cues: merging, rebasing, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clock


def merged(cues: DataFrame) -> DataFrame:
    """track_id, cue_no (from 1), start, end, text.

    In order of start, a cue joins the one before it if the texts are equal and it
    starts at most 0.1 s after that one's end. Two passes: blocks of equal
    neighbouring texts, then runs within a block that no gap parts. Valid since
    every cue ends after it starts.
    """
    order = Window.partitionBy("track_id").orderBy("start", "cue_ord")
    blocks = cues.withColumn("_new", F.coalesce((F.lag("text").over(order) != F.col("text")).cast("int"), F.lit(1)))
    blocks = blocks.withColumn("_block", F.sum("_new").over(order))
    inside = Window.partitionBy("track_id", "_block").orderBy("start", "cue_ord")
    reach = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    runs = blocks.withColumn("_cut", F.coalesce((F.col("start") > reach + 0.1).cast("int"), F.lit(1))).withColumn("_run", F.sum("_cut").over(inside))
    out = runs.groupBy("track_id", "_block", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("text").alias("text"))
    number = F.row_number().over(Window.partitionBy("track_id").orderBy("_block", "_run")).cast("long")
    return out.select("track_id", number.alias("cue_no"), "start", "end", "text")


def rebased(cues: DataFrame) -> DataFrame:
    """Cues of tracks whose first start is an hour or more, moved so that it is 0."""
    first = F.min("start").over(Window.partitionBy("track_id"))
    shift = F.when(first >= 3600, first).otherwise(F.lit(0.0))
    return cues.withColumn("_shift", shift).withColumns({"start": F.col("start") - F.col("_shift"), "end": F.col("end") - F.col("_shift")}).drop("_shift")


def rendered(cues: DataFrame, form: str) -> DataFrame:
    """track_id, body: the file of each track's merged cues, ``srt`` or ``vtt``."""
    point = "," if form == "srt" else "."
    times = F.concat(clock(F.col("start"), point), F.lit(" --> "), clock(F.col("end"), point), F.lit("\n"), F.col("text"), F.lit("\n\n"))
    block = F.concat(F.col("cue_no").cast("string"), F.lit("\n"), times) if form == "srt" else times
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_no", block.alias("b")))), lambda x: x["b"]), "")
    return cues.groupBy("track_id").agg(F.concat(F.lit("" if form == "srt" else "WEBVTT\n\n"), joined).alias("body"))
