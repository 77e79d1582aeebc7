"""Job and channel tables: admission, retention, health, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def health(jobs: DataFrame, most: int) -> DataFrame:
    """One row: running, total, most, and whether one more may start."""
    running = F.count_if(F.col("state") == "running")
    return jobs.agg(running.alias("running"), F.count(F.lit(1)).alias("total"), F.lit(most).cast("long").alias("most"), (running < most).alias("admits"))


def retained(jobs: DataFrame, now, retain_s: int, most: int = 5000) -> DataFrame:
    """Jobs that stay: finished ones older than ``retain_s`` go, then the oldest finished ones while there are over ``most``."""
    oldest = F.unix_timestamp(F.lit(now).cast("timestamp")) - retain_s
    finished = jobs.filter("state <> 'running'").filter(F.unix_timestamp("ended") >= oldest)
    # never more than ``most`` rows are ranked; how many of them have room is told by a join with one row
    newest = finished.orderBy(F.col("ended").desc(), F.col("id").desc()).limit(most)
    place = F.row_number().over(Window.orderBy(F.col("ended").desc(), F.col("id").desc()))
    room = jobs.agg((F.lit(most) - F.count_if(F.col("state") == "running")).alias("_room"))
    kept = newest.withColumn("_place", place).join(F.broadcast(room)).filter("_place <= _room").select(*jobs.columns)
    return jobs.filter("state = 'running'").unionByName(kept)


def captured(writes: DataFrame, most: int = 256 << 10) -> DataFrame:
    """What is kept of each job's output (id, n, text in the order of n): log, progress.

    Whenever a write makes the log longer than ``most`` bytes it is cut to its last
    half of that. ``progress`` is the last line of any write that tells of
    segments. A cut may split a character, which is then replaced.
    """
    size = F.octet_length("text").cast("long")
    later = Window.partitionBy("id").orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = writes.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_later", F.coalesce(F.sum(size).over(later), F.lit(0)))
    tells = F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit(" segs | ")))
    # no more than the last ``most`` bytes can be in the log; of earlier writes only the sizes count
    rows = rows.withColumns({"_line": F.try_element_at(tells, F.lit(-1)), "_size": size, "_tail": F.when(F.col("_later") < most, F.col("text"))})
    out = rows.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "_size"))), lambda x: x["_size"]).alias("_sizes"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_tail").isNotNull(), F.struct("n", "_tail")))), lambda x: x["_tail"]).alias("_tails"),
        F.max_by("_line", F.when(F.col("_line").isNotNull(), F.col("n"))).alias("_line"),
    )
    kept = F.aggregate("_sizes", F.lit(0).cast("long"), lambda had, x: F.when(had + x > most, F.lit(most // 2).cast("long")).otherwise(had + x))
    whole = F.array_join("_tails", "").cast("binary")
    cut = F.substr(whole, F.octet_length(whole) - kept.cast("int") + 1, kept.cast("int"))
    return out.select("id", F.make_valid_utf8(cut.cast("string")).alias("log"), F.coalesce(F.regexp_replace("_line", r"^\s+|\s+$", ""), F.lit("")).alias("progress"))


def stop_answers(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests (request_id, id) to stop a job: request_id, id, answer (stopping, no such job, job not running)."""
    rows = requests.join(jobs.select("id", "state"), "id", "left")
    answer = F.when(F.col("state").isNull(), F.lit("no such job")).when(F.col("state") != "running", F.lit("job not running")).otherwise(F.lit("stopping"))
    return rows.select("request_id", "id", answer.alias("answer"))


def stopped(jobs: DataFrame, answers: DataFrame) -> DataFrame:
    """Jobs after the stop requests that were answered by ``stopping`` have taken effect."""
    asked = answers.filter("answer = 'stopping'").select("id").distinct().withColumn("_asked", F.lit(True))
    return jobs.join(asked, "id", "left").withColumn("state", F.when(F.col("_asked"), F.lit("stopped")).otherwise(F.col("state"))).select(*jobs.columns)


def latest(events: DataFrame) -> DataFrame:
    """One row per job from its transitions (id, at, state, error): the last one, and when it began."""
    return events.groupBy("id").agg(F.max_by("state", "at").alias("state"), F.max_by("error", "at").alias("error"), F.min("at").alias("started"), F.max("at").alias("changed"))
