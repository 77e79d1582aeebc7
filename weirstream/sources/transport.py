"""MPEG transport streams as packet tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tscipher
from ..functions.binary import binary_array, views_of

SIZE = 188


def _byte(data: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(data, at + 1, 1)), 16, 10).cast("int")


def packets(segments: DataFrame) -> DataFrame:
    """stream, segment, pkt_no, raw, aligned, pid, pusi, afc, cc of segments (stream, segment, data).

    ``aligned`` holds up to the segment's first packet without sync byte; what
    follows that is passed on as it is. A last part packet is a packet too.
    """
    count = F.ceil(F.octet_length("data") / SIZE).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    rows = segments.select("stream", "segment", "data", F.explode(places).alias("pkt_no"))
    rows = rows.select("stream", "segment", F.col("pkt_no").cast("long").alias("pkt_no"), F.substr("data", F.col("pkt_no") * SIZE + 1, F.lit(SIZE)).alias("raw"))
    good = (_byte(F.col("raw"), 0) == 0x47) & (F.octet_length("raw") == SIZE)
    order = Window.partitionBy("stream", "segment").orderBy("pkt_no")
    rows = rows.withColumn("aligned", F.bool_and(good).over(order))
    b1, b2, b3 = (_byte(F.col("raw"), i) for i in (1, 2, 3))
    return rows.withColumns({
        "pid": F.when(F.col("aligned"), (b1 % 32) * 256 + b2).otherwise(F.lit(0x1FFF)),
        "pusi": F.coalesce((F.floor(b1 / 64) % 2) == 1, F.lit(False)),
        "afc": F.when(F.col("aligned"), (F.floor(b3 / 16) % 4).cast("int")).otherwise(F.lit(0)),
        "cc": F.coalesce(b3 % 16, F.lit(0)),
    })


def _counting(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a segment's packets those that count (with payload, no null packets, before the first without sync byte): their places, PIDs, and numbers among those of the PID."""
    n = len(b) // SIZE
    head = b[: n * SIZE].reshape(n, SIZE)[:, :4]
    lost = np.flatnonzero(head[:, 0] != 0x47)
    head = head[: lost[0]] if len(lost) else head
    pid = (head[:, 1].astype(np.int32) & 31) << 8 | head[:, 2]
    places = np.flatnonzero((head[:, 3] >> 4 & 1 == 1) & (pid != 0x1FFF))
    pid = pid[places]
    by_pid = np.argsort(pid, kind="stable")
    ordered = pid[by_pid]
    nth = np.empty(len(pid), np.int64)
    nth[by_pid] = np.arange(len(pid)) - np.searchsorted(ordered, ordered)
    return places, pid, nth


_COUNTS = pa.list_(pa.struct([("pid", pa.int32()), ("n", pa.int64())]))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("n", T.LongType())])))
def payload_counts(data: pa.Array) -> pa.Array:
    """How many packets of each PID count in a segment. The segments are read where Arrow has them."""
    b, at = views_of(data)
    null = np.asarray(data.is_null())
    counts = []
    for i in range(len(data)):
        pids, n = np.unique(_counting(b[:0] if null[i] else b[at[i] : at[i + 1]])[1], return_counts=True)
        counts.append([{"pid": p, "n": k} for p, k in zip(pids.tolist(), n.tolist(), strict=True)])
    return pa.array(counts, _COUNTS)


@F.arrow_udf(T.BinaryType())
def recounted(data: pa.Array, starts: pa.Array) -> pa.Array:
    """Segments whose counters go on from ``starts``, an array of struct<pid, before>. A batch is copied once and changed in the copy."""
    b, at = views_of(data)
    null = np.asarray(data.is_null())
    out, borders = b[at[0] : at[-1]].copy(), at.astype(np.int64) - at[0]
    for i in np.flatnonzero(~null).tolist():
        segment = out[borders[i] : borders[i + 1]]
        places, pid, nth = _counting(segment)
        before = {s["pid"]: s["before"] for s in starts[i].as_py() or ()}
        first = np.array([before.get(p, 0) for p in pid.tolist()], np.int64)
        heads = places * SIZE + 3
        segment[heads] = segment[heads] & 0xF0 | ((first + nth) % 16).astype(np.uint8)
    return binary_array(out, borders, null)


def counts_of(segments: DataFrame) -> DataFrame:
    """stream, segment, pid, n of segments (stream, segment, data), batch or stream."""
    rows = segments.select("stream", "segment", F.explode(payload_counts("data")).alias("c"))
    return rows.select("stream", "segment", F.col("c.pid").alias("pid"), F.col("c.n").alias("n"))


def rewritten(segments: DataFrame, starts: DataFrame) -> DataFrame:
    """Segments with counters that go on from ``starts`` (stream, segment, pid, before); the bytes are changed in their rows."""
    by_segment = starts.groupBy(F.col("stream").alias("_st"), F.col("segment").alias("_seg")).agg(F.collect_list(F.struct("pid", "before")).alias("_starts"))
    rows = segments.join(by_segment, F.col("stream").eqNullSafe(F.col("_st")) & F.col("segment").eqNullSafe(F.col("_seg")), "left")
    return rows.select("stream", "segment", recounted("data", "_starts").alias("data"))


def continued(segments: DataFrame) -> DataFrame:
    """Segments with continuity counters that run on over all of a stream's segments. Only the counts are added up across segments."""
    counts = counts_of(segments)
    earlier = Window.partitionBy("stream", "pid").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return rewritten(segments, counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))


def sections(b: bytes, pid: int) -> Iterator[bytes]:
    """Whole PSI sections of one PID, put together over packets."""
    held = tscipher.Sections()
    for at in range(0, len(b) - SIZE + 1, SIZE):
        packet = b[at : at + SIZE]
        if packet[0] == 0x47 and (packet[1] & 31) << 8 | packet[2] == pid and (found := held.push(packet)):
            yield found


def of_pid(data: Column, pid: int) -> Column:
    """The whole packets of one PID of a segment, one behind another; none of null data."""
    heads = [F.lit(bytes([0x47, flags << 5 | pid >> 8, pid & 255])) for flags in range(8)]
    count = F.floor(F.octet_length(data) / SIZE).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    kept = F.filter(places, lambda i: F.substr(data, i * SIZE + 1, F.lit(3)).isin(heads))
    return F.unhex(F.array_join(F.transform(kept, lambda i: F.hex(F.substr(data, i * SIZE + 1, F.lit(SIZE)))), ""))


def services(segments: DataFrame) -> DataFrame:
    """stream, segment, service, provider, name, iv of the services that a segment's tables name.

    ``iv`` is what the name holds for the cipher over packets (see ``tscipher``),
    16 bytes, or null. Names are read as UTF-8. Only the packets of the services' PID go to Python.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for stream, segment, b in zip(frame["stream"], frame["segment"], frame["data"], strict=True):
                named = {}  # of one segment, each once
                for section in sections(b, tscipher.SERVICES):
                    for service, provider, name in tscipher.service_names(section):
                        iv = tscipher.iv_of(name)
                        named[service, provider.decode("utf-8", "replace"), name.decode("utf-8", "replace"), iv and iv.ljust(16, b"\0")] = None
                rows.extend((stream, segment, *about) for about in named)
            yield pd.DataFrame(rows, columns=["stream", "segment", "service", "provider", "name", "iv"])

    kinds = {c: segments.schema[c].dataType.simpleString() for c in ("stream", "segment")}
    told = segments.select("stream", "segment", of_pid(F.col("data"), tscipher.SERVICES).alias("data"))
    return told.mapInPandas(read, f"stream {kinds['stream']}, segment {kinds['segment']}, service int, provider string, name string, iv binary")


def programs(segments: DataFrame) -> DataFrame:
    """stream, segment, program, pmt_pid, pid, stream_type of each elementary stream that a segment's tables name."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for stream, segment, b in zip(frame["stream"], frame["segment"], frame["data"], strict=True):
                for pat in sections(b, 0) if b is not None else ():
                    for i in range(8, len(pat) - 4, 4):
                        program, pid = int.from_bytes(pat[i : i + 2], "big"), int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF
                        for pmt in sections(b, pid) if program else ():
                            at = 12 + (int.from_bytes(pmt[10:12], "big") & 0xFFF)
                            while at + 5 <= len(pmt) - 4:
                                rows.append((stream, segment, program, pid, int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF, pmt[at]))
                                at += 5 + (int.from_bytes(pmt[at + 3 : at + 5], "big") & 0xFFF)
            yield pd.DataFrame(rows, columns=["stream", "segment", "program", "pmt_pid", "pid", "stream_type"]).drop_duplicates()

    return segments.select("stream", "segment", "data").mapInPandas(read, "stream string, segment long, program int, pmt_pid int, pid int, stream_type int")
