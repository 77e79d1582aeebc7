"""Catalog tables derived from the driver's tables, so that operators run at every size.

``SQL`` has the same definitions as common table expressions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choice(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _millis() -> Column:
    """Milliseconds since 1970 of an event, whatever the session's time zone."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000")


HEIGHTS = [360, 480, 720, 1080, 2160]
LANGUAGES = ["en", "fr", "de", "es", ""]


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of manifests of about 40 from parts."""
    p = table(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 3
    video, audio = kind == 0, kind == 1
    group = F.concat(F.lit("g"), (F.col("p_size") % 4).cast("string"))
    height = F.when(video, _choice(HEIGHTS, F.col("p_partkey") % 5)).otherwise(F.lit(0))
    return p.select(
        F.concat(F.lit("m"), F.floor(F.col("p_partkey") / 40).cast("string")).alias("manifest_id"),
        F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_partkey").alias("ord"),
        _choice(["video", "audio", "subtitles"], kind).alias("media_type"),
        kind.cast("int").alias("type_ord"),
        F.floor(F.col("p_retailprice") * 1000).cast("bigint").alias("bandwidth"),
        F.floor(height * 16 / 9).cast("int").alias("width"),
        height.cast("int").alias("height"),
        F.col("p_type").alias("codecs"),
        F.when(video, F.lit("")).otherwise(_choice(LANGUAGES, F.col("p_size") % 5)).alias("language"),
        F.col("p_name").alias("name"),
        F.when(audio, _choice(["2", "6", ""], F.col("p_size") % 3)).otherwise(F.lit("")).alias("channels"),
        (F.col("p_size") % 11 == 0).alias("is_default"),
        F.when(video & (F.col("p_size") % 5 != 0), group).otherwise(F.lit("")).alias("audio_group"),
        F.when(video & (F.col("p_size") % 7 != 0), group).otherwise(F.lit("")).alias("subs_group"),
        F.when(~video & (F.col("p_size") % 6 != 0), group).otherwise(F.lit("")).alias("group_id"),
        (video & (F.col("p_size") % 2 == 0)).alias("muxed_audio"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of one stream per user from events; URLs repeat."""
    e = table(spark, sf_dir, "events")
    init = F.when(F.col("event_id") % 7 != 0, F.struct(F.concat(F.lit("init-"), (F.floor(F.col("event_id") / 900) % 3).cast("string"), F.lit(".mp4")).alias("url"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("range")))
    return e.select(
        F.col("user_id").alias("stream_id"),
        F.col("event_id").alias("seg_ord"),
        F.concat("event_type", F.lit("-"), (F.col("event_id") % 500).cast("string")).alias("url"),
        (F.col("value") / 50).alias("duration"),
        F.lit(None).cast("struct<start:bigint,end:bigint>").alias("range"),
        init.alias("init"),
        (F.col("event_type") == "error").alias("discontinuity"),
    )


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of one track per user; starts are wall-clock seconds."""
    start = _millis() / 1000.0
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"), F.col("event_id").alias("cue_ord"), start.alias("start"), (start + F.col("value") * 100).alias("end"), F.col("event_type").alias("text")
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as they come in at a live window; every fifth has no duration."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"),
        F.col("event_id").alias("arrival"),
        F.when(F.col("event_id") % 5 == 0, F.lit(0.0)).otherwise(F.col("value") / 50).alias("duration"),
        (F.col("event_type") == "error").alias("discontinuity"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("n_bytes"),
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track per user, nine to a presentation: two thirds live, a quarter with a declared bitrate."""
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    return u.select(
        F.floor(F.col("user_id") / 9).cast("bigint").alias("presentation"), F.col("user_id").alias("track_id"), F.col("user_id").alias("ord"), _choice(["video", "audio", "subtitles"], F.col("user_id") % 3).alias("media_type"),
        (F.col("user_id") % 3 != 0).alias("live"), (F.col("user_id") % 3 == 0).alias("ended"), (F.col("user_id") % 2 == 0).alias("fmp4"), (F.col("user_id") % 4 != 1).alias("has_init"),
        F.when(F.col("user_id") % 4 == 0, F.col("user_id") * 1000 + 64000).otherwise(F.lit(0)).alias("bandwidth"),
        F.when(F.col("user_id") % 5 == 0, F.lit("")).otherwise(F.lit("avc1.64001f")).alias("codecs"), F.when(F.col("user_id") % 3 == 0, F.lit(1280)).otherwise(F.lit(0)).alias("width"),
        F.when(F.col("user_id") % 3 == 0, F.lit(720)).otherwise(F.lit(0)).alias("height"), F.lit(25.0).alias("frame_rate"), F.when(F.col("user_id") % 2 == 0, F.lit("en")).otherwise(F.lit("")).alias("language"),
        F.lit("").alias("name"), F.lit("2").alias("channels"), (F.col("user_id") % 10 == 0).alias("is_default"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each planned segment: errors of large value failed."""
    e = table(spark, sf_dir, "events")
    idx = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    return e.select(F.col("user_id").alias("stream_id"), idx.alias("idx"), (~((F.col("event_type") == "error") & (F.col("value") > 300))).alias("ok"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly throughput and error counts of eight channels."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("channel"), F.floor(_millis() / 3600000).cast("bigint").alias("tick"), "value", "event_type")
    return e.groupBy("channel", "tick").agg(F.sum(F.floor(F.col("value") * 100).cast("bigint")).cast("double").alias("bytes"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 400)).alias("errs"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative bytes of each user, a sample an event."""
    total = F.sum(F.floor(F.col("value") * 100).cast("bigint")).over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("channel"), F.col("event_id"), (F.floor(F.col("event_id") * 7)).cast("bigint").alias("t_ms"), total.alias("total_bytes"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "O", F.lit("running")).when(F.col("o_orderstatus") == "F", F.lit("done")).otherwise(F.lit("error"))
    return o.select(F.col("o_orderkey").alias("id"), state.alias("state"), F.col("o_orderdate").alias("ended"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pid = F.when(F.col("event_id") % 13 == 0, F.lit(0x1FFF)).otherwise(256 + F.col("user_id") % 4)
    return e.select((F.col("user_id") % 5).alias("stream"), F.floor(F.col("event_id") / 100).cast("bigint").alias("segment"), F.col("event_id").alias("pkt_no"), pid.cast("int").alias("pid"), (F.col("event_id") % 4).cast("int").alias("afc"), F.lit(9).alias("cc"))


SQL = {
    "v_streams": """
        SELECT 'm' || (p_partkey // 40) AS manifest_id, 't' || p_partkey AS id, p_partkey AS ord,
               ['video', 'audio', 'subtitles'][p_partkey % 3 + 1] AS media_type, (p_partkey % 3)::INT AS type_ord,
               floor(p_retailprice * 1000)::BIGINT AS bandwidth,
               floor((CASE WHEN p_partkey % 3 = 0 THEN [360, 480, 720, 1080, 2160][p_partkey % 5 + 1] ELSE 0 END) * 16 / 9)::INT AS width,
               (CASE WHEN p_partkey % 3 = 0 THEN [360, 480, 720, 1080, 2160][p_partkey % 5 + 1] ELSE 0 END)::INT AS height,
               p_type AS codecs, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ['en', 'fr', 'de', 'es', ''][p_size % 5 + 1] END AS language, p_name AS name,
               CASE WHEN p_partkey % 3 = 1 THEN ['2', '6', ''][p_size % 3 + 1] ELSE '' END AS channels, p_size % 11 = 0 AS is_default,
               CASE WHEN p_partkey % 3 = 0 AND p_size % 5 <> 0 THEN 'g' || (p_size % 4) ELSE '' END AS audio_group,
               CASE WHEN p_partkey % 3 = 0 AND p_size % 7 <> 0 THEN 'g' || (p_size % 4) ELSE '' END AS subs_group,
               CASE WHEN p_partkey % 3 <> 0 AND p_size % 6 <> 0 THEN 'g' || (p_size % 4) ELSE '' END AS group_id,
               p_partkey % 3 = 0 AND p_size % 2 = 0 AS muxed_audio
        FROM part""",
    "v_ranked": """
        SELECT *, row_number() OVER (PARTITION BY manifest_id, media_type ORDER BY type_ord, -height,
               CASE WHEN media_type = 'audio' AND is_default THEN 0 ELSE 1 END, CASE WHEN media_type = 'audio' THEN -coalesce(try_cast(channels AS DOUBLE), 0) ELSE 0 END,
               bandwidth DESC, ord)::INT AS rank
        FROM v_streams""",
    "v_segments": """
        SELECT user_id AS stream_id, event_id AS seg_ord, event_type || '-' || (event_id % 500) AS url, value / 50 AS duration,
               CASE WHEN event_id % 7 <> 0 THEN 'init-' || (event_id // 900 % 3) || '.mp4' END AS init_url, event_type = 'error' AS discontinuity
        FROM events""",
    "v_cues": """
        SELECT user_id AS track_id, event_id AS cue_ord, (epoch_us(ts) // 1000) / 1000.0::DOUBLE AS start, (epoch_us(ts) // 1000) / 1000.0::DOUBLE + value * 100 AS "end", event_type AS text
        FROM events""",
    "v_arrivals": """
        SELECT user_id AS track_id, event_id AS arrival, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE value / 50 END::DOUBLE AS duration,
               event_type = 'error' AS discontinuity, floor(value * 1000)::BIGINT AS n_bytes
        FROM events""",
    "v_tracks": """
        SELECT DISTINCT user_id // 9 AS presentation, user_id AS track_id, user_id AS ord, ['video', 'audio', 'subtitles'][user_id % 3 + 1] AS media_type, user_id % 3 <> 0 AS live,
               user_id % 3 = 0 AS ended, user_id % 2 = 0 AS fmp4, user_id % 4 <> 1 AS has_init, CASE WHEN user_id % 4 = 0 THEN user_id * 1000 + 64000 ELSE 0 END::BIGINT AS bandwidth,
               CASE WHEN user_id % 5 = 0 THEN '' ELSE 'avc1.64001f' END AS codecs, CASE WHEN user_id % 2 = 0 THEN 'en' ELSE '' END AS language,
               user_id % 10 = 0 AS is_default
        FROM events""",
    "v_window": """
        WITH a AS (
            SELECT *, CASE WHEN duration > 0 THEN duration END AS given,
                   greatest(max(CASE WHEN duration > 0 THEN duration END) OVER b, CASE WHEN first_value(duration) OVER w <= 0 THEN 2.0 END) AS seen
            FROM v_arrivals WINDOW w AS (PARTITION BY track_id ORDER BY arrival), b AS (PARTITION BY track_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), d AS (SELECT *, coalesce(given, seen, 2.0)::DOUBLE AS dur FROM a), m AS (SELECT *, floor(dur * 1000 + 0.5)::BIGINT AS ms FROM d)
        SELECT track_id, arrival, duration, discontinuity, n_bytes, dur, ms, row_number() OVER w - 1 AS seq,
               coalesce(sum(ms) OVER (PARTITION BY track_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms,
               (row_number() OVER (PARTITION BY track_id ORDER BY arrival DESC))::INT AS newest
        FROM m WINDOW w AS (PARTITION BY track_id ORDER BY arrival)""",
    "v_visible": "SELECT w.*, t.live, t.fmp4 FROM v_window w JOIN v_tracks t USING (track_id) WHERE NOT t.live OR newest <= 6",
    "v_retained": "SELECT w.*, t.live, t.fmp4 FROM v_window w JOIN v_tracks t USING (track_id) WHERE NOT t.live OR newest <= 9",
    "v_outcomes": """
        SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, NOT (event_type = 'error' AND value > 300) AS ok FROM events""",
    "v_ticks": """
        SELECT user_id % 8 AS channel, (epoch_us(ts) // 1000) // 3600000 AS tick, sum(floor(value * 100)::BIGINT)::DOUBLE AS bytes,
               count(*) FILTER (event_type = 'error' AND value > 400) AS errs
        FROM events GROUP BY ALL""",
    "v_samples": """
        SELECT user_id AS channel, event_id, event_id * 7 AS t_ms, (sum(floor(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS total_bytes FROM events""",
    "v_jobs": """
        SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'done' ELSE 'error' END AS state, o_orderdate AS ended FROM orders""",
    "v_packets": """
        SELECT user_id % 5 AS stream, event_id // 100 AS segment, event_id AS pkt_no, (CASE WHEN event_id % 13 = 0 THEN 8191 ELSE 256 + user_id % 4 END)::INT AS pid,
               (event_id % 4)::INT AS afc, 9 AS cc
        FROM events""",
    "v_merged": """
        WITH a AS (SELECT *, CASE WHEN lag(text) OVER (PARTITION BY track_id ORDER BY start, cue_ord) = text THEN 0 ELSE 1 END AS fresh FROM v_cues),
        b AS (SELECT *, sum(fresh) OVER (PARTITION BY track_id ORDER BY start, cue_ord) AS block FROM a),
        c AS (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY track_id, block ORDER BY start, cue_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.1 THEN 1 ELSE 0 END AS cut FROM b),
        d AS (SELECT *, sum(cut) OVER (PARTITION BY track_id, block ORDER BY start, cue_ord) AS run FROM c),
        e AS (SELECT track_id, block, run, min(start) AS start, max("end") AS "end", any_value(text) AS text FROM d GROUP BY ALL)
        SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY block, run) AS cue_no, start, "end", text FROM e""",
    "v_rebased": """
        SELECT track_id, cue_no, start - shift AS start, "end" - shift AS "end", text
        FROM (SELECT *, CASE WHEN min(start) OVER (PARTITION BY track_id) >= 3600 THEN min(start) OVER (PARTITION BY track_id) ELSE 0 END AS shift FROM v_merged)""",
}


def with_views(query: str, *names: str) -> str:
    """DuckDB SQL with the named views in front."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + query
