import re

from weirstream.sources import transport


def packet(pid, cc, payload=b"", start=False, afc=1):
    return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, afc << 4 | cc]) + payload.ljust(184, b"\xff")


def frame(spark, *segments):
    return spark.createDataFrame([("s", i, bytearray(b)) for i, b in enumerate(segments)], "stream string, segment long, data binary")


def test_counters_run_on(spark):
    one = packet(256, 9) * 3 + packet(0x1FFF, 7) + packet(256, 5, afc=2)
    two = packet(256, 0) * 2 + b"\0" * 188 + packet(256, 3) + b"tail"
    got = {r.segment: bytes(r.data) for r in transport.continued(frame(spark, one, two)).collect()}
    assert got[0] == packet(256, 0) + packet(256, 1) + packet(256, 2) + packet(0x1FFF, 7) + packet(256, 5, afc=2)
    assert got[1] == packet(256, 3) + packet(256, 4) + b"\0" * 188 + packet(256, 3) + b"tail"


def test_programs(spark):
    pat = bytes([0, 0xB0, 13, 0, 1, 0xC1, 0, 0, 0, 1, 0xE1, 0x00]) + bytes(4)
    streams = bytes([0x1B, 0xE1, 0x01, 0xF0, 2]) + b"ab" + bytes([0x0F, 0xE1, 0x02, 0xF0, 0])
    pmt = bytes([2, 0xB0, 13 + len(streams), 0, 1, 0xC1, 0, 0, 0xE1, 0x01, 0xF0, 0]) + streams + bytes(4)
    data = packet(0, 0, b"\0" + pat, True) + packet(256, 0, b"\0" + pmt, True)
    got = [(r.program, r.pmt_pid, r.pid, r.stream_type) for r in transport.programs(frame(spark, data)).collect()]
    assert got == [(1, 256, 257, 0x1B), (1, 256, 258, 0x0F)]


def test_packets_are_numbered_within_segments(spark):
    from weirstream.functions import binary

    rows = [(t, g, n, p, 2 if n % 5 == 0 else 1, 9) for t in ("a", None) for g in (0, 1, 3) for n in range(30) for p in (256, 257, 0x1FFF)]
    frame = spark.createDataFrame(rows, "stream string, segment int, pkt_no int, pid int, afc int, cc int")
    out = binary.continuity(frame)
    got = {tuple(r)[:4]: r["out_cc"] for r in out.collect()}
    seen, want = {}, {}
    for t, g, n, p, afc, cc in rows:
        goes_on = afc == 1 and p != 0x1FFF
        want[t, g, n, p] = seen.get((t, p), 0) % 16 if goes_on else cc
        seen[t, p] = seen.get((t, p), 0) + goes_on
    assert got == want and out.columns == [*frame.columns, "out_cc"] and out.count() == len(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    numbering = [x for x in plan.splitlines() if "row_number" in x]
    assert numbering and not any(re.search(r"segment#\d+ ASC", x) for x in numbering)


def test_only_tables_go_to_python(spark):
    name = b"mdcm|p|s|?" + b"0a" * 16
    body = bytes([0, 1, 0xFF, 0, 5, 0xFC, 0, len(name) + 5, 0x48, len(name) + 3, 1, 0, len(name)]) + name
    section = bytes([0x42, 0xF0, len(body) + 10, 0, 1, 0xC1, 0, 0]) + body + bytes(4)
    table, video = packet(17, 0, b"\0" + section, True), packet(256, 0, b"x") * 500
    data = video + table + packet(0x1111, 0) + b"\0" + table[1:] + video + table[:100]
    frame_ = frame(spark, data, data + table).union(spark.createDataFrame([("s", 2, None), ("s", 3, b"")], "stream string, segment long, data binary"))
    assert [bytes(r.t) for r in frame_.select("segment", transport.of_pid(frame_["data"], 17).alias("t")).orderBy("segment").collect()] == [table, table + table[:100] + table[:88], b"", b""]
    twice = frame(spark, data + bytes(88) + table).union(frame(spark, data)).coalesce(1)
    got = [(r.segment, r.service, r.name, bytes(r.iv)) for r in transport.services(twice).collect()]
    assert got == [(0, 5, name.decode(), b"\n" * 12 + bytes(4))] * 2  # rows are told apart whatever the frames, names of one are given once


def test_counters_of_arrow_arrays():
    import pyarrow as pa

    one, two = packet(256, 9) * 2 + packet(0x1FFF, 7) + packet(257, 1), packet(256, 0) + b"\0" * 188 + packet(256, 3) + b"tail"
    data = pa.array([b"skipped", one, None, b"", two], pa.binary()).slice(1)
    counts = transport.payload_counts.func(data).to_pylist()
    assert counts == [[{"pid": 256, "n": 2}, {"pid": 257, "n": 1}], [], [], [{"pid": 256, "n": 1}]]
    starts = pa.array([[{"pid": 256, "before": 15}], None, None, [{"pid": 256, "before": 5}]])
    want = [packet(256, 15) + packet(256, 0) + packet(0x1FFF, 7) + packet(257, 0), None, b"", packet(256, 5) + two[188:]]
    assert transport.recounted.func(data, starts).to_pylist() == want and data.to_pylist() == [one, None, b"", two]
    assert transport.recounted.func(data.slice(0, 0), starts.slice(0, 0)).to_pylist() == []
