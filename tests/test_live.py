"""Polling, order and ends of live streams, ordered files."""

import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weirstream.sources import fetch
from weirstream.streaming import files, ordering, polling

SEEN: dict[str, int] = {}


class Site(BaseHTTPRequestHandler):
    """/a.m3u8 moves on and ends with its third refresh, /b.m3u8 fails at first, /c.mpd loses its second track."""

    def do_GET(self):
        n = SEEN[self.path] = SEEN.get(self.path, 0) + 1
        lines = "".join(f"#EXTINF:2,\n#EXT-X-BYTERANGE:10@{i}\ns{i}.ts\n" for i in range(n, n + 5))
        body = "#EXTM3U\n#EXT-X-TARGETDURATION:1\n" + lines + ("#EXT-X-ENDLIST\n" if n == 3 and self.path == "/a.m3u8" else "")
        if self.path == "/c.mpd":
            second = '<Representation id="two"/>' if n == 1 else ""
            body = f'<MPD type="dynamic" minimumUpdatePeriod="PT0.5S" availabilityStartTime="2024-01-01T00:00:00Z" timeShiftBufferDepth="PT4S"><Period><AdaptationSet mimeType="video/mp4"><SegmentTemplate media="$RepresentationID$-{n}-$Time$"><SegmentTimeline><S t="{n * 2}" d="2"/></SegmentTimeline></SegmentTemplate><Representation id="one"/>{second}</AdaptationSet></Period></MPD>'
        code = 404 if self.path == "/b.m3u8" and n == 1 else 200
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body.encode() if code == 200 else b"")

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_what_bodies_tell():
    assert polling.told("﻿#EXTM3U\n#EXT-X-TARGETDURATION:6\n") == (True, 3.0)
    assert polling.told("#EXTM3U\n#EXT-X-TARGETDURATION:6\n#EXT-X-ENDLIST") == (False, 0.0)
    assert polling.told("#EXTM3U\n") == (True, 0.0)
    assert polling.told('<MPD type="dynamic" minimumUpdatePeriod="PT1M2.5S">') == (True, 62.5)
    assert polling.told("<MPD type='dynamic' timeShiftBufferDepth='PT10S'>") == (True, 5.0)
    assert polling.told('<MPD type="dynamic">') == (True, 2.0)
    assert polling.told('<MPD type="static">') == (False, 0.0) and polling.told("<html>") == (False, 0.0)


def test_streams_are_asked_when_due(tmp_path):
    reader = polling.LiveReader({"streams": "a\tu\nb\tv\nc\tw", "state": str(tmp_path), "interval": "10", "per_task": "2"})
    assert reader.initialOffset() == {"n": 0}
    assert reader.latestOffset() == {"n": 1}
    parts = reader.partitions({"n": 0}, {"n": 1})
    assert [p.value for p in parts] == [(0, [("a", "u"), ("b", "v")], 0), (0, [("c", "w")], 1)]
    now = time.time()
    reader._write("told-0-0", [["a", True, 100.0, now - 50], ["b", True, 0.0, now - 50]])
    reader._write("told-0-1", [["c", False, 0.0, now - 50]])
    again = polling.LiveReader(reader_options(tmp_path))  # a query that was started again plans the same refresh
    assert [p.value for p in again.partitions({"n": 0}, {"n": 1})] == [p.value for p in parts]
    assert again.latestOffset() == {"n": 2}
    assert [p.value for p in again.partitions({"n": 1}, {"n": 2})] == [(1, [("b", "v")], 0)]  # a waits for its own interval, c has ended
    again._write("told-1-0", [["b", True, 5.0, now]])
    assert again.latestOffset() == {"n": 2} and again.partitions({"n": 2}, {"n": 2}) == []


def reader_options(path):
    return {"streams": "a\tu\nb\tv\nc\tw", "state": str(path), "interval": "10", "per_task": "2"}


def test_feed_follows_streams(spark, site, tmp_path):
    known = spark.createDataFrame([("a", None), ("b", None), ("c", "one.0.0"), ("d", "two.0.1")], "stream_id string, id string")
    urls = "\n".join(f"{s}\t{site}/{f}" for s, f in (("a", "a.m3u8"), ("b", "b.m3u8"), ("c", "c.mpd"), ("d", "c.mpd")))
    feed = polling.Feed(spark, known, str(tmp_path / "feed"), {"streams": urls, "interval": "0.2", "retries": "0", "per_task": "4"})
    query = feed.refreshing(processingTime="0 seconds")
    rows, end = [], time.time() + 120
    try:
        while time.time() < end and not (any(r.stream_id == "a" and not r.live for r in rows) and any(r.stream_id == "b" and not r.lost for r in rows) and any(r.stream_id == "c" and r.n > 0 for r in rows)):
            time.sleep(1)
            rows = spark.read.schema(feed.SEGMENTS).parquet(f"{feed.path}/segments/batch=*").collect() if os.path.exists(f"{feed.path}/segments/batch=0/_SUCCESS") else []
    finally:
        query.stop()
    assert SEEN["/a.m3u8"] == 3  # what has ended isn't asked again
    assert any(r.lost and r.url is None for r in rows if r.stream_id == "b" and r.n == 0)
    assert all(r.lost for r in rows if r.stream_id == "d" and r.n > 0) and any(not r.lost for r in rows if r.stream_id == "c" and r.n > 0)
    out = feed.fresh(["s4"]).select("stream_id", "url", "range.start").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    out.awaitTermination()
    fresh = sorted((r.url.rsplit("/", 1)[1], r.start) for r in spark.read.parquet(str(tmp_path / "out")).filter("stream_id = 'a'").collect())
    assert fresh == [("s3.ts", 3), ("s5.ts", 5), ("s6.ts", 6), ("s7.ts", 7)]  # of s1 to s5 the newest three, no s4


def test_late_pieces_become_holes(spark, tmp_path):
    ordering.use_rocksdb(spark)
    schema = "stream_id string, idx long, ok boolean, name string"
    batches = [[("a", 2, True, "two"), ("a", 0, True, "zero"), ("b", 1, True, "one")], [("a", 0, True, "again"), ("a", 3, False, "failed"), ("c", 0, True, "x")], [("b", 0, True, "late")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*"))
    query = ordering.in_order(source, patience_s=1.0).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start(str(tmp_path / "out"))
    try:
        end, seen = time.time() + 90, []
        while time.time() < end and len(seen) < 7:
            time.sleep(1)
            seen = spark.read.schema("stream_id string, idx long, hole boolean, name string").parquet(str(tmp_path / "out")).collect() if (tmp_path / "out").exists() else []
    finally:
        query.stop()
    got = sorted(map(tuple, seen))
    assert [x for x in got if x[0] == "a"] == [("a", 0, False, "zero"), ("a", 1, True, None), ("a", 2, False, "two"), ("a", 3, True, "failed")]
    assert [x for x in got if x[0] != "a"][-1] == ("c", 0, False, "x")
    assert [x for x in got if x[0] == "b"] in ([("b", 0, False, "late"), ("b", 1, False, "one")], [("b", 0, True, None), ("b", 1, False, "one")])


def test_query_stops_when_all_streams_have_ended(spark, tmp_path):
    ordering.use_rocksdb(spark)
    schema = "stream_id string, n long, duration double, live boolean, asked_to_stop boolean"
    for i, rows in enumerate([[("a", 0, 2.0, True, False), ("b", 0, 9.0, True, False)], [("a", 1, 1.0, False, False), ("b", 1, 1.0, True, False)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*"))
    listener = ordering.StopWhenEnded(spark, "ending", 2)
    spark.streams.addListener(listener)
    try:
        out = ordering.until_stop(source, 5.0).writeStream.queryName("ending").format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start(str(tmp_path / "out"))
        assert out.awaitTermination(90)
    finally:
        spark.streams.removeListener(listener)
    assert listener.ended == 2
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("a", 0, 2.0, False), ("a", 1, 1.0, True), ("b", 0, 9.0, True)]


def test_streams_end_by_the_clock(spark, tmp_path):
    ordering.use_rocksdb(spark)
    spark.createDataFrame([("a", 3, 2.0, True, False)], "stream_id string, n long, duration double, live boolean, asked_to_stop boolean").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("stream_id string, n long, duration double, live boolean, asked_to_stop boolean").parquet(str(tmp_path / "in"))
    listener = ordering.StopWhenEnded(spark, "clock", 1)
    spark.streams.addListener(listener)
    try:
        out = ordering.until_stop(source, 0.0, clock_s=2.0).writeStream.queryName("clock").format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start(str(tmp_path / "out"))
        assert out.awaitTermination(90)
    finally:
        spark.streams.removeListener(listener)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("a", 3, 0.0, True), ("a", 3, 2.0, False)]


def pieces(spark, rows):
    return spark.createDataFrame(rows, "stream string, idx long, ok boolean, data binary")


def test_files_go_on_after_failures(spark, tmp_path):
    path = str(tmp_path / "files")
    rows = [("a", i, i != 5, bytes([65 + i]) * (i + 1)) for i in range(9)] + [("b", 0, True, None), ("b", 1, True, b"x"), ("c", 1, True, b"no first")]
    files.append(pieces(spark, rows).repartition(5), path)
    assert open(f"{path}/a", "rb").read() == b"".join(bytes([65 + i]) * (i + 1) for i in range(5))
    assert {r.stream: (r.next_idx, r.offset) for r in files.states(spark, path).collect()} == {"a": (5, 15), "b": (2, 1)} and not os.path.exists(f"{path}/c")
    with open(f"{path}/a", "ab") as f:  # what a lost run wrote beyond the state
        f.write(b"????" * 20)
    again = [(s, i, True, d) for s, i, _, d in rows if s == "a"]
    sink = files.FileSink(path)
    for _ in range(2):  # a batch that comes twice
        sink.write(pieces(spark, again).repartition(3), 7)
    assert {r.stream: r.next_idx for r in files.states(spark, path).collect()}["a"] == 9
    assert open(f"{path}/a", "rb").read()[:45] == b"".join(bytes([65 + i]) * (i + 1) for i in range(9))


def test_aborted_writes_leave_files_as_they_were(spark, tmp_path):
    path = str(tmp_path / "files")
    files.append(pieces(spark, [("a", 0, True, b"first")]), path)
    bad = pieces(spark, [("a", 1, True, b"second")]).select("stream", "idx", F.lit(9).cast("long").alias("offset"), "data")
    with pytest.raises(Exception, match="go on from 1 at 5"):
        bad.write.format("ordered_files").mode("append").save(path)
    assert open(f"{path}/a", "rb").read() == b"first" and json.load(open(f"{path}/a.state")) == {"next_idx": 1, "offset": 5}
    with open(f"{path}/a.state", "w") as f:
        f.write("{broken")
    files.append(pieces(spark, [("a", 0, True, b"FIRST"), ("a", 1, True, b"!")]), path)
    assert open(f"{path}/a", "rb").read() == b"FIRST!"


def test_streamed_pieces_are_put_in_order(spark, tmp_path):
    """Three runs and one of the last batch again, as after a failure between commit and checkpoint."""
    import shutil

    schema = "stream string, idx long, ok boolean, data binary"
    parts = [[("a", 1, True, b"one"), ("b", 0, True, b"B")], [("a", 0, True, b"zero"), ("a", 3, True, b"three")], [("a", 2, False, b"lost"), ("b", 1, True, b"")]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"in/part={i}"))
        files.stream_into(spark.readStream.schema(schema).parquet(str(tmp_path / "in/part=*")), str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True).awaitTermination()
    want = {"a": b"zeroonethree", "b": b"B"}
    assert {n: open(tmp_path / "out" / n, "rb").read() for n in want} == want
    last = max(int(n) for n in os.listdir(tmp_path / "state/commits") if n.isdigit())
    os.remove(tmp_path / f"state/commits/{last}")
    shutil.rmtree(tmp_path / "state/commits/.crc", ignore_errors=True)
    for n in os.listdir(tmp_path / "state/commits"):
        if n.startswith(f".{last}"):
            os.remove(tmp_path / "state/commits" / n)
    files.stream_into(spark.readStream.schema(schema).parquet(str(tmp_path / "in/part=*")), str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True).awaitTermination()
    assert {n: open(tmp_path / "out" / n, "rb").read() for n in want} == want
    assert json.load(open(tmp_path / "out/a.state")) == {"next_idx": 4, "offset": 12} and json.load(open(tmp_path / "out/b.state")) == {"next_idx": 2, "offset": 1}


class Kept(dict):
    """A state variable that counts what is asked of it."""

    calls = 0

    def _count(self, x=None):
        Kept.calls += 1
        return x

    def get(self):
        return self._count(dict.get(self, ()))

    def update(self, row):
        self._count(self.__setitem__((), row))

    def getValue(self, key):
        return self._count(dict.get(self, key))

    def containsKey(self, key):
        return self._count(key in self)

    def updateValue(self, key, row):
        self._count(self.__setitem__(key, row))

    def removeKey(self, key):
        self._count(self.pop(key))


class Handle:
    def getValueState(self, *about):
        return Kept()

    getMapState = getValueState


def test_waiting_pieces_are_kept_by_runs():
    step = ordering._Reorder("s", [("data", "binary")], True, 0.0, "data")
    step.init(Handle())
    take = lambda ids: [f for f in step.handleInputRows(("a",), iter([pd.DataFrame({"idx": ids, "ok": True, "data": [b"x" * (1 + i % 3) if i != 7 else b"y" * 99999 for i in ids]})]), None)]
    Kept.calls = 0
    assert take(list(range(600, 0, -1))) == [] and Kept.calls < 12
    (out,) = take([0])
    assert Kept.calls < 30 and out["idx"].tolist() == list(range(601)) and len(out["data"][7]) == 99999
    assert (out["offset"].diff().dropna().astype(int) == out["data"].map(len)[:-1].to_numpy()).all() and not step.stored and not step.own


def test_of_a_file_only_the_range_is_read(tmp_path):
    with open(tmp_path / "large", "wb") as f:
        f.truncate(1 << 40)  # would not fit
        f.seek(5)
        f.write(b"here")
    url, status, body, length, _, error = fetch.get(f"file://{tmp_path}/large", (5, 8))
    assert (status, body, length, error) == (200, b"here", 1 << 40, "")


def test_tracks_of_a_group_are_one_call():
    from weirstream.streaming import live

    class State:
        exists, calls, get = False, 0, None

        def update(self, row):
            self.exists, self.get, self.calls = True, row, self.calls + 1

    state, big = State(), (1 << 53) + 1
    rows = [(t, n, d) for t in (big, big + 1, None, 0) for n, d in enumerate([0.0, 3.0, None, 0.0, 4.0, 0.0])]
    frame = pd.DataFrame({"nameless": [t is None for t, *_ in rows], "track_id": [t or 0 for t, *_ in rows], "arrival": [n for _, n, _ in rows], "duration": [d for *_, d in rows], "discontinuity": False})
    got = {}
    for part in (frame[frame["arrival"] < 3].sample(frac=1, random_state=1), frame[frame["arrival"] >= 3]):
        (out,) = live._take((5,), iter([part.iloc[:4], part.iloc[4:]]), state)
        for r in out.itertuples(index=False):
            got.setdefault(None if pd.isna(r.track_id) else int(r.track_id), []).append((r.seq, r.dur, r.start_ms, r.published))
    one = [(0, 2.0, 0, 1), (1, 3.0, 2000, 2), (2, 3.0, 5000, 3), (3, 3.0, 8000, 4), (4, 4.0, 11000, 5), (5, 4.0, 15000, 6)]
    assert got == dict.fromkeys((big, big + 1, None, 0), one) and state.calls == 2


def test_streams_of_a_group_are_one_value_of_the_state():
    step = ordering._Ending(40.0, 0.0)
    step.init(Handle())
    ids = [(1 << 53) + i for i in range(1000)]
    frame = lambda n: pd.DataFrame({"nameless": [False] * 1000 + [True], "stream_id": [*ids, 0], "n": n, "duration": 25.0, "live": True, "asked_to_stop": [i == 0 for i in range(1001)]})
    Kept.calls = 0

    class Timer:
        getCurrentProcessingTimeInMs = staticmethod(lambda: 0)

    outs = [list(step.handleInputRows((7,), iter([frame(n)]), Timer)) for n in range(3)]
    assert Kept.calls == 6 and outs[2] == []
    assert [(r.stream_id, r.n, r.last) for r in outs[0][0].itertuples()] == [(s, 0, s == ids[0]) for s in [*ids, None]]
    assert [(r.stream_id, r.n, r.last) for r in outs[1][0].itertuples()] == [(s, 1, True) for s in [*ids[1:], None]]


def test_streams_without_a_number_end_too(spark, tmp_path):
    ordering.use_rocksdb(spark)
    rows = [(s, n, None if n == 1 else 3.0, True, False) for s in ((1 << 53) + 1, 1 << 53, None) for n in range(4)]
    source = "stream_id long, n long, duration double, live boolean, asked_to_stop boolean"
    spark.createDataFrame(rows, source).write.parquet(str(tmp_path / "in"))
    ordering.until_stop(spark.readStream.schema(source).parquet(str(tmp_path / "in")), 6.0).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(s, n, d, n == 2) for s in ((1 << 53) + 1, 1 << 53, None) for n, d in ((0, 3.0), (1, 0.0), (2, 3.0))}


def test_recorded_refreshes_are_read_by_files(spark, tmp_path):
    rows = [(f"s{i}", n, f"u{i}", None if i == 7 else f"#EXTM3U\n{i}" + "\n#EXT-X-ENDLIST" * (i % 2)) for i in range(1000) for n in (0, 2)]
    spark.createDataFrame(rows, "stream_id string, n long, url string, body string").repartition(5).write.partitionBy("n").parquet(str(tmp_path / "recorded"))
    reader = polling.LiveReader({"snapshots": str(tmp_path / "recorded"), "state": str(tmp_path / "told"), "refreshes": "3"})
    assert [reader.latestOffset() for _ in range(4)] == [{"n": 1}, {"n": 2}, {"n": 3}, {"n": 3}]
    parts = reader.partitions({"n": 0}, {"n": 3})
    assert sorted(p.value[0] for p in parts) == [0] * 5 + [2] * 5  # nothing was recorded of the refresh between
    batches = [b for p in parts for b in reader.read(p)]
    got = sorted((r["stream_id"], r["n"], r["url"], r["body"]) for b in batches for r in b.to_pylist())
    assert got == sorted(rows) and len(batches) == 10 and {r["live"] for b in batches for r in b.to_pylist() if r["body"]} == {True, False}


def test_commits_hold_some_streams_at_a_time(tmp_path, monkeypatch):
    import pickle

    import pyarrow as pa

    monkeypatch.setattr(files, "STREAMS", 7, raising=False)
    monkeypatch.setattr(files, "LOG_BYTES", 50, raising=False)
    rows = [{"stream": f"s\n{i:03}", "idx": n, "offset": 4 * n, "data": b"four"} for i in range(100) for n in range(1 + i % 3)]
    wanted = {f"s\n{i:03}": (1 + i % 3, 4 + i % 3 * 4) for i in range(100)}
    for writer in (files.OrderedWriter, files.OrderedStreamWriter):
        path = tmp_path / writer.__name__
        path.mkdir()
        task = writer({"path": str(path)})
        messages = [task.write(iter([pa.RecordBatch.from_pylist(part)] if part else [])) for part in (rows[:50], [], rows[50:120], rows[120:])] + [None]
        assert all(len(pickle.dumps(m)) < 400 for m in messages)
        held = [len(part) for part in files._merged(messages)]
        assert max(held) <= 7 and sum(held) == 100
        gap = [task.write(iter([pa.RecordBatch.from_pylist([{"stream": "z", "idx": 1, "offset": 0, "data": b"x"}])]))]
        about = (3,) if writer is files.OrderedStreamWriter else ()
        with pytest.raises(ValueError, match="don't go on from 0 at 0"):
            writer({"path": str(path)}).commit(messages + gap, *about)
        assert not [n for n in os.listdir(path) if n.endswith(".state")]
        writer({"path": str(path)}).abort(gap, *about)
        writer({"path": str(path)}).commit(messages, *about)
        assert {s: files._state_of(str(path / s)) for s in wanted} == wanted
        assert not [n for n in os.listdir(path) if n.startswith(".")] and (path / "z").read_bytes() == b""


def test_folders_of_files_are_listed_by_tasks(spark, tmp_path):
    for name, body in {"a": b"12345", "b": b"12", "c": b"", ".hidden": b"x", "_aside": b"x"}.items():
        (tmp_path / name).write_bytes(body)
    for name, state in {"a": '{"next_idx": 3, "offset": 5}', "b": '{"next_idx": 3, "offset": 5}', "c": "{bro\xff", "lost": '{"next_idx": 3, "offset": 0}'}.items():
        (tmp_path / f"{name}.state").write_bytes(state.encode("latin-1"))
    told = files.states(spark, f"file://{tmp_path}")
    assert sorted(map(tuple, told.collect())) == [("a", 3, 5), ("b", 0, 0), ("c", 0, 0)] and not told.inputFiles()
    assert sorted((r.stream, bytes(r.content)) for r in files.bodies(spark, str(tmp_path)).collect()) == [("a", b"12345"), ("b", b"12"), ("c", b"")]


def test_downloads_are_listed_by_tasks(spark, tmp_path):
    """The driver keeps no index of what was fetched."""
    import hashlib

    from weirstream import live_queries

    rows = [(i, i % 3, ("view", "click", "error")[i % 2], 1.0) for i in range(40)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    out = live_queries.downloads(spark, str(tmp_path))
    want = {f"user-{u}.ts": b"".join(f"{i} {kind * (i % 7)}\n".encode() for i, user, kind, _ in rows if user == u) for u in range(3)}
    assert sorted(map(tuple, out.collect())) == sorted((s, len(b), hashlib.md5(b).hexdigest()) for s, b in want.items())  # noqa: S324
    assert not out.inputFiles()
