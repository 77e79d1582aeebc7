import random

from pyspark.sql import functions as F

from weirstream.operators import jobs, telemetry
from weirstream.plans import segments

SEG = "stream_id string, seg_ord long, url string, range struct<start:bigint,end:bigint>, init struct<url:string>"


def test_plan(spark):
    rows = [("s", i, f"u{i}", None, init) for i, init in enumerate([("a",), ("a",), None, ("a",), ("b",), ("a",)])]
    got = segments.planned(spark.createDataFrame(rows, SEG)).orderBy("idx").collect()
    assert [(r.is_init, r.url) for r in got] == [(True, "a"), (False, "u0"), (False, "u1"), (False, "u2"), (False, "u3"), (True, "b"), (False, "u4"), (True, "a"), (False, "u5")]
    assert [r.idx for r in got] == list(range(9))


def test_dedupe_by_url_and_range(spark):
    rows = [("s", 0, "u", (0, 9), None), ("s", 1, "u", (10, 19), None), ("s", 2, "u", (0, 9), None), ("t", 3, "u", (0, 9), None)]
    assert sorted(r.seg_ord for r in segments.deduplicated(spark.createDataFrame(rows, SEG)).collect()) == [0, 1, 3]


def test_commit_stops_at_failures_and_gaps(spark):
    rows = [("s", 0, True), ("s", 1, False), ("s", 2, True), ("t", 0, True), ("t", 2, True), ("u", 1, True)]
    frame = spark.createDataFrame(rows, "stream_id string, idx long, ok boolean")
    assert sorted((r.stream_id, r.idx) for r in segments.committed(frame).collect()) == [("s", 0), ("t", 0)]
    assert segments.committed(frame, live=True).count() == 5


def test_resume(spark):
    states = spark.createDataFrame([("a", '{"next_idx":2,"offset":14}', 14), ("b", '{"next_idx":2,"offset":14}', 13), ("c", "junk", 99)], "stream_id string, state string, file_bytes long")
    points = segments.resume_points(states)
    assert {r.stream_id: (r.next_idx, r.offset) for r in points.collect()} == {"a": (2, 14), "b": (0, 0), "c": (0, 0)}
    plan = spark.createDataFrame([("a", i) for i in range(5)], "stream_id string, idx long")
    assert segments.pending(plan, points).count() == 3


def ticks(spark, values):
    return spark.createDataFrame([("c", i, float(b), e) for i, (b, e) in enumerate(values)], "channel string, tick long, bytes double, errs long")


def limits(frame):
    return [r["limit"] for r in frame.orderBy("tick").collect()]


def test_adaptive_limit(spark):
    assert limits(telemetry.adaptive_limit(ticks(spark, [(2.0**i, 0) for i in range(6)])))[-1] == 64
    assert limits(telemetry.adaptive_limit(ticks(spark, [(100, 0)] * 5), start=40)) == [64, 64, 64, 64, 64]
    assert limits(telemetry.adaptive_limit(ticks(spark, [(100, 1), (500, 0), (900, 0), (990, 0), (1200, 0), (100, 0)]), start=40)) == [20, 20, 20, 20, 22, 20]
    assert min(limits(telemetry.adaptive_limit(ticks(spark, [(1, 1)] * 8)))) == 4


def test_fixed_limit(spark):
    assert limits(telemetry.fixed_limit(ticks(spark, [(1, 1), (1, 0), (1, 0), (1, 0), (1, 0)]), most=16)) == [8, 8, 8, 9, 10]


def test_limits_over_blocks_match_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(c, t, float(rng.choice([0, 50, 100, 104, 107, 120, 400])), int(rng.random() < 0.06)) for c, n in (("a", 300), (None, 90), ("one", 1)) for t in sorted(rng.sample(range(-400, 400), n))]
    rows += [("a", 500, None, None), ("a", 501, 7.0, 0)]
    frame = spark.createDataFrame(rows, "channel string, tick long, bytes double, errs long")

    def loop(fixed: bool) -> set:
        out = set()
        for name in {r[0] for r in rows}:
            limit, doubling, hold, prev = (32, False, 0, 0.0) if fixed else (16, True, 0, 0.0)
            for _, tick, n, errs in (r for r in rows if r[0] == name):
                told = n is not None and prev is not None
                grows, rises, falls = (told and n > prev * 1.05, told and n > prev * 1.10, told and n < prev * 0.90)
                step = max(1, limit // 8)
                if errs:
                    limit, doubling, hold = max(4, limit // 2), False, 2
                elif hold:
                    hold -= 1
                elif fixed:
                    limit = min(32, limit + step)
                elif doubling:
                    limit, doubling = min(64, limit * 2) if grows else limit, grows
                elif rises:
                    limit = min(64, limit + step)
                elif falls:
                    limit = max(4, limit - step)
                out.add((name, tick, limit))
                prev = n
        return out

    for fixed, rule in ((False, telemetry.adaptive_limit), (True, telemetry.fixed_limit)):
        for block in (1, 7, 512):
            got = rule(frame, block=block).collect()
            assert len(got) == len(rows) and {tuple(r) for r in got} == loop(fixed)
    assert telemetry.adaptive_limit(frame.limit(0)).count() == 0


def test_progress(spark):
    rows = spark.createDataFrame([(10, 20, 1000, 10.0), (5, 20, 1000, 10.0), (10, 20, 1000, 0.5), (0, 0, 0, 0.0)], "done long, total long, bytes long, speed double")
    assert [(r.percent, r.eta) for r in telemetry.progress(rows).collect()] == [(50, "100"), (25, "?"), (50, "?"), (0, "?")]


def test_jobs(spark):
    rows = spark.createDataFrame([(1, "running", None), (2, "done", "2024-01-01 00:00:00"), (3, "error", "2024-01-02 00:00:00"), (4, "done", "2023-01-01 00:00:00")], "id long, state string, ended string").withColumn("ended", F.col("ended").cast("timestamp"))
    assert sorted(r.id for r in jobs.retained(rows, "2024-01-03 00:00:00", 7 * 86400, 2).collect()) == [1, 3]
    assert jobs.health(rows, 1).first().admits is False
    writes = spark.createDataFrame([(1, 1, "a\n1 segs | x\n"), (1, 2, "2 segs | y \nend"), (1, 3, None), (2, 1, "z" * 20 + "é"), (3, 1, "")], "id long, n long, text string")
    got = {r.id: (r.log, r.progress) for r in jobs.captured(writes, 20).collect()}
    assert got == {1: ("gs | y \nend"[-10:], "2 segs | y"), 2: ("z" * 8 + "é", ""), 3: ("", "")}
    assert {r.id: r.log for r in jobs.captured(writes).collect()}[1] == "a\n1 segs | x\n2 segs | y \nend"
    asked = spark.createDataFrame([(1, 1), (2, 2), (3, 9), (4, 1)], "request_id long, id long")
    answers = jobs.stop_answers(asked, rows)
    assert {r.request_id: r.answer for r in answers.collect()} == {1: "stopping", 2: "job not running", 3: "no such job", 4: "stopping"}
    assert {r.id: r.state for r in jobs.stopped(rows, answers).collect()} == {1: "stopped", 2: "done", 3: "error", 4: "done"}
    events = spark.createDataFrame([(1, 1, "running", ""), (1, 2, "done", ""), (2, 1, "running", "")], "id long, at long, state string, error string")
    assert {r.id: r.state for r in jobs.latest(events).collect()} == {1: "done", 2: "running"}


def test_progress_text(spark):
    rows = [(49, 400, 3 << 20, 5000.9, False, 0.0), (9, 10, 100, 2.0, False, 0.0), (0, 0, 0, 0.0, False, 0.0), (3, 9, 1536, float(1 << 30), True, 3723.5), (5, 9, 2500, 10.0, True, 59.4)]
    got = [r.line for r in telemetry.progress_text(spark.createDataFrame(rows, "done long, total long, bytes long, speed double, live boolean, elapsed_s double")).collect()]
    assert got == [
        " 12.2% | 49/400 segs | 3.0MiB | 5KiB/s | ETA 1h15m5s", " 90.0% | 9/10 segs | 100B | 2B/s | ETA 5s", "  0.0% | 0/0 segs | 0B | 0B/s | ETA ?",
        "REC 1h2m4s | 3 segs | 2KiB | 1.00GiB/s", "REC 59s | 5 segs | 2KiB | 10B/s",
    ]
