"""What a service tells of itself: status lines, viewers, pressure, stop rules, requests that can't be met."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bytes_text, retriable


def status_lines(stats: DataFrame, by: str = "presentation") -> DataFrame:
    """One row per presentation, ``line``: each track's segments in the window, in the order of ``ord``."""
    part = F.concat(F.col("track_id").cast("string"), F.lit(": "), F.col("in_window").cast("string"), F.lit(" segs"), F.when(F.col("ended"), F.lit(" (ended)")).otherwise(F.lit("")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", part.alias("text")))), lambda x: x["text"])
    return stats.groupBy(by).agg(F.array_join(parts, " | ").alias("line"))


def viewers(transfers: DataFrame) -> DataFrame:
    """Per channel (channel, viewer, n_bytes): viewers, segments sent, bytes, and bytes for people."""
    out = transfers.groupBy("channel").agg(F.countDistinct("viewer").alias("viewers"), F.count(F.lit(1)).alias("segments"), F.sum("n_bytes").alias("bytes"))
    return out.withColumn("shown", bytes_text(F.col("bytes")))


def pressure(responses: DataFrame) -> DataFrame:
    """Per fetch (fetch_id, attempt, status): attempts, those that called for another try, and the last status."""
    return responses.groupBy("fetch_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(retriable(F.col("status"))).alias("pressure"), F.max_by("status", "attempt").alias("status"))


def channel_health(channels: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each channel with the state of its job; ``missing`` where the job is gone."""
    states = jobs.select(F.col("id").alias("job_id"), "state")
    return channels.join(states, "job_id", "left").select("channel", "job_id", F.coalesce("state", F.lit("missing")).alias("state"), F.coalesce(F.col("state") == "running", F.lit(False)).alias("healthy"))


def looked_up(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests (request_id, id) with the job's state and ``found``."""
    return requests.join(jobs.select("id", "state"), "id", "left").select("request_id", "id", F.col("state").isNotNull().alias("found"), F.coalesce("state", F.lit("")).alias("state"))


def until_stop(refreshes: DataFrame, limit_s: float) -> DataFrame:
    """Refreshes (stream_id, n, duration of what was new, live, asked_to_stop) that are still taken.

    A stream ends with the refresh by which its taken duration reaches ``limit_s``
    (0: no limit), that says it isn't live any more, or at which a stop was asked for.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("stream_id").orderBy("n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    over = (F.lit(limit_s) > 0) & (F.sum("duration").over(order) >= limit_s)
    ended = over | ~F.col("live") | F.col("asked_to_stop")
    rows = refreshes.withColumn("_ended", ended.cast("int"))
    return rows.withColumn("_before", F.coalesce(F.max("_ended").over(before), F.lit(0))).filter("_before = 0").withColumn("last", F.col("_ended") == 1).drop("_ended", "_before")


def refusals(requests: DataFrame) -> DataFrame:
    """Requests that can't be met, with the first reason.

    n_streams, n_segments, protected, has_key, method (of the segments' key), out
    (hls, ts or dash), fmp4, listen (address), secret, channel, url.
    """
    c = F.col
    local = c("listen").rlike(r"^(?:localhost|127\.[0-9.]+|\[::1\]|::1)(?::[0-9]+)?$")
    rules: list[tuple[Column, str]] = [
        (~c("channel").rlike("^[A-Za-z0-9_-]{1,64}$"), "channel id"),
        (c("url") == "", "no address"),
        (~c("out").isin("", "hls", "ts", "dash"), "unknown format"),
        (~local & (c("listen") != "") & (c("secret") == ""), "open address needs a secret"),
        (c("n_streams") == 0, "nothing selected"),
        (c("n_segments") == 0, "no segments"),
        (c("method") == "SAMPLE-AES", "sample encryption"),
        (c("protected") & ~c("has_key"), "protected without key"),
        ((c("out") == "dash") & ~c("fmp4"), "not fragmented"),
    ]
    reason = F.lit(None).cast("string")
    for test, text in reversed(rules):
        reason = F.when(test, F.lit(text)).otherwise(reason)
    return requests.withColumn("reason", reason).filter("reason IS NOT NULL")
