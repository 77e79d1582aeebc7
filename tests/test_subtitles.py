from pyspark.sql import functions as F

from weirstream.functions.scalars import clock
from weirstream.operators import cues
from weirstream.sources import subtitles


def files(spark, body):
    return spark.createDataFrame([("t", body)], "track_id string, body string")


def test_vtt(spark):
    body = "WEBVTT - made here\n\n00:07.250 --> 00:09.000\nrain\n\nWEBVTT\n\n00:07.250 --> 00:09.000\nrain\n\n8\n00:01:10,500 --> 00:01:12,000 position:10%\nwind\nand snow\n00:20.000 --> 00:20.000\nnothing\n\n01:30.000 --> 01:31.125\nsun\n"
    rows = cues.merged(subtitles.parse_vtt(files(spark, body))).orderBy("cue_no").collect()
    assert [(r.start, r.end, r.text) for r in rows] == [(7.25, 9.0, "rain"), (70.5, 72.0, "wind\nand snow"), (90.0, 91.125, "sun")]


def test_ttml(spark):
    body = '<tt tickRate="25"><body><p begin="00:00:02.250" end="00:00:04.000">sun<br/>rain</p><p id="b" begin="5.5s" end="7s"><span>wind</span> &lt;east&gt;</p><p begin="200t" end="250t">by ticks</p><p>no times</p></body></tt>'
    rows = subtitles.parse_ttml(files(spark, body)).orderBy("start").collect()
    assert [(r.start, r.end, r.text) for r in rows] == [(2.25, 4.0, "sun\nrain"), (5.5, 7.0, "wind <east>"), (8.0, 10.0, "by ticks")]
    assert [r.text for r in subtitles.parse_ttml(files(spark, '<p end="900ms" begin="0.2s">turned</i></p>')).collect()] == ["turned"]


def test_sniff(spark):
    cases = {
        "WEBVTT\n": "vtt", "\ufeff WEBVTT": "vtt", "<?xml version='1.0'?><x/>": "ttml", "<tt xml:lang='en'>": "ttml", "junk <tt:tt>": "ttml", "see note:tt": "unknown",
        "\0\0\0\x18ftypmp42": "fmp4", "\0\0\0\x08free\0\0\0\x08moofx": "fmp4", "moof": "unknown", "12\n00:00:01,500 --> 00:00:02,000": "srt", "1\r\n00:00:01,500 --> x": "srt", "a --> b": "unknown", "?": "unknown",
    }
    rows = spark.createDataFrame([(b,) for b in cases], "b string").select("b", subtitles.sniff(F.col("b")).alias("k")).collect()
    assert {r.b: r.k for r in rows} == cases


def test_merge_and_rebase(spark):
    rows = [("t", 1, 4000.0, 4001.0, "a"), ("t", 2, 4001.05, 4003.0, "a"), ("t", 3, 4003.2, 4004.0, "a"), ("t", 4, 4003.3, 4004.0, "b"), ("u", 1, 5.0, 6.0, "x")]
    merged = cues.merged(spark.createDataFrame(rows, "track_id string, cue_ord long, start double, end double, text string"))
    got = [(r.track_id, r.start, r.end, r.text) for r in cues.rebased(merged).orderBy("track_id", "cue_no").collect()]
    assert [(t, round(s, 3), round(e, 3), x) for t, s, e, x in got] == [("t", 0.0, 3.0, "a"), ("t", 3.2, 4.0, "a"), ("t", 3.3, 4.0, "b"), ("u", 5.0, 6.0, "x")]


def test_render(spark):
    rows = spark.createDataFrame([("t", 1, 1.0, 2.5, "hi"), ("t", 2, 3.0, 4.0, "yo")], "track_id string, cue_no long, start double, end double, text string")
    assert cues.rendered(rows, "srt").first().body == "1\n00:00:01,000 --> 00:00:02,500\nhi\n\n2\n00:00:03,000 --> 00:00:04,000\nyo\n\n"
    assert cues.rendered(rows, "vtt").first().body.startswith("WEBVTT\n\n00:00:01.000 --> 00:00:02.500\nhi\n\n")
    assert spark.range(1).select(clock(F.lit(3723.5), ",").alias("c")).first().c == "01:02:03,500"


def test_paragraphs_go_without_their_file(spark):
    rows = subtitles.parse_ttml(files(spark, '<p begin="1s" end="2s">a</p>').repartition(2))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "body" not in plan[: plan.index("Generate")] and "body" not in plan[plan.index("Generate") :].split("\n")[0]


def test_cues_that_end_when_they_start(spark):
    body = "WEBVTT\n\n00:07.250 --> 00:07.250\nrain\n\n00:09.000 --> 00:08.000\nwind\n\n00:09.000 --> 00:10.000\nsun\n"
    assert [r.text for r in subtitles.parse_vtt(files(spark, body)).collect()] == ["sun"]
    assert sorted((r.start, r.text) for r in subtitles.parse_vtt(files(spark, body), instants=True).collect()) == [(7.25, "rain"), (9.0, "sun")]


def test_files_of_more_than_99_hours(spark, tmp_path):
    from weirstream import live_queries

    spark.createDataFrame([(1, 359999, "a"), (1, 360000, "b"), (2, 360001, "c"), (3, 720000, "d")], "user_id long, event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.track_id: r.body for r in live_queries.subtitle_files(spark, str(tmp_path)).collect()}
    assert got[2] == "1\n00:00:00,000 --> 00:00:01,250\nc & 360001\n\n" and got[1].count("-->") == 2 and got[3].count("-->") == 1


def test_events_without_length_come_back(spark, tmp_path):
    from weirstream import queries

    spark.sql("SELECT 1L AS user_id, 1L AS event_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts, 'view' AS event_type, 0.0D AS value UNION ALL SELECT 1L, 2L, TIMESTAMP_NTZ'2024-01-01 00:00:09', 'click', 0.5D").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted((r.cue_no, r.start, r.end) for r in queries.vtt_parse(spark, str(tmp_path)).collect()) == [(1, 0.0, 0.0), (2, 9.0, 59.0)]
