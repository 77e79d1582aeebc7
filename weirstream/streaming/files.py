"""Pieces in order in one file a stream: ``df.write.format("ordered_files")``, and what makes it resumable.

Tasks write pieces straight to their places in the streams' files, so a long stream is
written by many tasks, and a task that is run again writes the same bytes to the same
place. What is committed is told by a state file beside each file, the next index and
the length; it is put in place whole, after the bytes. An aborted write leaves files
as they were, cut to that length. Files lie in a folder that driver and executors
share and that can be written at any place (a POSIX file system).
"""

from __future__ import annotations

import contextlib
import heapq
import json
import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from pyspark.sql.streaming import StreamingQuery

from ..plans.segments import committed, resume_points
from . import ordering

STATE = ".state"
#: So many states are written side by side, as each waits for its disk, and so many streams are held at once by a commit.
COMMITS, STREAMS = 32, 4096
#: Of each log so many bytes are held while logs are merged.
LOG_BYTES = 1 << 14
#: Bodies of files come in frames of about so many bytes.
FRAME_BYTES = 1 << 22


@dataclass
class Written(WriterCommitMessage):
    """The log of a task, a file that tells what it wrote: a JSON line for each stream, in the order of their names. Null if it wrote nothing."""

    log: str | None


def _logs(messages: list[Written | None]) -> list[str]:
    return [m.log for m in messages if m and m.log]


def _lines(log: str) -> Iterator[list]:
    """The lines of a log (stream, first and last index, first byte and the byte behind the last, sum of lengths, number of pieces); it is open only while it is read."""
    place, rest = 0, b""
    while True:
        with open(log, "rb") as f:
            f.seek(place)
            more = f.read(LOG_BYTES)
        if not more:
            return
        place += len(more)
        *whole, rest = (rest + more).split(b"\n")
        yield from map(json.loads, whole)


def _merged(messages: list[Written | None]) -> Iterator[dict[str, tuple[int, int, int, int, int, int]]]:
    """What all tasks wrote, ``STREAMS`` streams at a time: stream to first and last index, first byte and the byte behind the last, sum of lengths, number of pieces."""
    part: dict[str, tuple[int, int, int, int, int, int]] = {}
    for stream, a, z, low, high, size, n in heapq.merge(*(_lines(log) for log in _logs(messages)), key=lambda line: line[0]):
        if stream not in part and len(part) == STREAMS:
            yield part
            part = {}
        b = part.get(stream, (a, z, low, high, 0, 0))
        part[stream] = (min(a, b[0]), max(z, b[1]), min(low, b[2]), max(high, b[3]), size + b[4], n + b[5])
    if part:
        yield part


def _state_of(path: str) -> tuple[int, int]:
    """next_idx and offset; what can't be read, or tells of more than there is, starts over."""
    try:
        with open(path + STATE, encoding="utf-8") as f:
            told = json.load(f)
        found = int(told["next_idx"]), int(told["offset"])
        return found if os.path.getsize(path) >= found[1] else (0, 0)
    except (OSError, ValueError, KeyError, TypeError):
        return 0, 0


class OrderedWriter(DataSourceArrowWriter):
    """What a task wrote goes into a log in a hidden folder beside the files, so that the driver holds some streams at a time."""

    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://").rstrip("/")
        self.logs = os.path.join(self.path, f".written-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files: dict[str, tuple[int, int, int, int, int, int]] = {}
        name, handle = None, None
        try:
            for batch in iterator:
                for stream, idx, at, data in zip(*(batch.column(c).to_pylist() for c in ("stream", "idx", "offset", "data")), strict=True):
                    if stream != name:  # pieces come sorted, so a file is opened once
                        if handle is not None:
                            os.close(handle)
                        name, handle = stream, os.open(os.path.join(self.path, stream), os.O_RDWR | os.O_CREAT, 0o644)
                    view, place = memoryview(data or b""), at
                    while len(view):
                        put = os.pwrite(handle, view, place)
                        view, place = view[put:], place + put
                    a, z, low, high, size, n = files.get(stream, (idx, idx, at, at, 0, 0))
                    files[stream] = (min(a, idx), max(z, idx), min(low, at), max(high, place), size + len(data or b""), n + 1)
        finally:
            if handle is not None:
                os.fsync(handle)
                os.close(handle)
        if not files:
            return Written(None)
        os.makedirs(self.logs, exist_ok=True)
        log = os.path.join(self.logs, uuid.uuid4().hex)
        with open(log, "w", encoding="utf-8") as f:
            f.writelines(json.dumps([stream, *about]) + "\n" for stream, about in sorted(files.items()))
        return Written(log)

    def commit(self, messages: list[Written | None]) -> None:
        """New states, of streams whose pieces go on without a gap from the state before; else none is changed."""
        self._commit(messages, False)

    def _commit(self, messages: list[Written | None], again: bool) -> None:
        with ThreadPoolExecutor(COMMITS) as pool:
            for part in _merged(messages):  # all are checked before the first is put
                self._new(part, pool, again)
            for part in _merged(messages):
                new = self._new(part, pool, again) if again else part
                list(pool.map(self._tell, new, [z + 1 for _, z, *_ in new.values()], [high for _, _, _, high, *_ in new.values()]))
        self._forget(messages)

    def _new(self, part: dict[str, tuple[int, int, int, int, int, int]], pool: ThreadPoolExecutor, again: bool) -> dict[str, tuple[int, int, int, int, int, int]]:
        """The streams whose state is to change."""
        before = list(pool.map(_state_of, [os.path.join(self.path, stream) for stream in part]))
        new = {}
        for (stream, about), (next_idx, offset) in zip(part.items(), before, strict=True):
            a, z, low, high, size, n = about
            if again and (z + 1, high) == (next_idx, offset):  # this batch was committed before
                continue
            if (a, low) != (next_idx, offset) or high - low != size or z - a + 1 != n:
                raise ValueError(f"pieces of {stream} don't go on from {next_idx} at {offset}: {a} to {z}, {n} of them, at {low} to {high}")
            new[stream] = about
        return new

    def _tell(self, stream: str, next_idx: int, offset: int) -> None:
        path = os.path.join(self.path, stream)
        temporary = f"{path}{STATE}.{uuid.uuid4().hex}"
        with open(temporary, "w", encoding="utf-8") as f:
            json.dump({"next_idx": next_idx, "offset": offset}, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path + STATE)

    def _forget(self, messages: list[Written | None]) -> None:
        """Logs go, and their folder with them when it is empty."""
        for log in _logs(messages):
            with contextlib.suppress(OSError):
                os.remove(log)
            with contextlib.suppress(OSError):
                os.rmdir(os.path.dirname(log))

    def abort(self, messages: list[Written | None]) -> None:
        """Files as their states say. Those of tasks that told nothing are cut when they are next written."""
        for part in _merged(messages):
            for path in (os.path.join(self.path, stream) for stream in part):
                os.truncate(path, _state_of(path)[1])
        self._forget(messages)


class OrderedStreamWriter(OrderedWriter, DataSourceStreamArrowWriter):
    """The same for the batches of a stream; one that comes again after it was committed changes nothing."""

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        os.makedirs(self.path, exist_ok=True)
        self._commit(messages, True)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        OrderedWriter.abort(self, messages)


class OrderedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ordered_files"

    def schema(self) -> str:
        return "stream string, idx long, offset long, data binary"

    def writer(self, schema, overwrite: bool) -> OrderedWriter:
        return OrderedWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> OrderedStreamWriter:
        return OrderedStreamWriter(self.options)


def _listed(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Names of a folder's files that end so, dealt to as many tasks as shuffles have. The folder is read by one task, which holds some names at a time."""

    def names(_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with os.scandir(path) as found:
            shown = (e.name for e in found if e.name.endswith(suffix) and e.name[0] not in "._" and e.is_file())
            while part := list(islice(shown, STREAMS)):
                yield pd.DataFrame({"name": part})

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.range(0, 1, 1, 1).mapInPandas(names, "name string").repartition(tasks)


def states(spark: SparkSession, path: str) -> DataFrame:
    """stream, next_idx, offset of the files in a folder, as their state files tell (see ``segments.resume_points``)."""
    path = path.removeprefix("file://")

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for stream in frame["name"].str.removesuffix(STATE):
                with contextlib.suppress(FileNotFoundError), open(os.path.join(path, stream + STATE), encoding="utf-8", errors="replace") as f:
                    rows.append((stream, f.read(), os.path.getsize(os.path.join(path, stream))))
            yield pd.DataFrame(rows, columns=["stream_id", "state", "file_bytes"]).astype({"file_bytes": "int64"})

    rows = _listed(spark, path, STATE).mapInPandas(told, "stream_id string, state string, file_bytes long")
    return resume_points(rows).withColumnRenamed("stream_id", "stream")


def bodies(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """stream, content of the files in a folder whose names end so; states are none of them."""
    path = path.removeprefix("file://")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, size = [], 0
            for stream in frame["name"]:
                with open(os.path.join(path, stream), "rb") as f:
                    rows.append((stream, f.read()))
                size += len(rows[-1][1])
                if size >= FRAME_BYTES:
                    yield pd.DataFrame(rows, columns=["stream", "content"])
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["stream", "content"])

    return _listed(spark, path, suffix).filter(~F.col("name").endswith(STATE)).mapInPandas(read, "stream string, content binary")


def _told(path: str):
    """next_idx and offset of streams by name, read where the function runs, once a task."""

    @F.pandas_udf("next_idx long, offset long")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found: dict[str, tuple[int, int]] = {}
        for streams in batches:
            found |= {s: _state_of(os.path.join(path, s)) for s in streams.dropna().unique() if s not in found}
            yield pd.DataFrame([found.get(s, (0, 0)) for s in streams], columns=["next_idx", "offset"])

    return told


def append(pieces: DataFrame, path: str, live: bool = False) -> None:
    """Put pieces (stream, idx, ok, data) behind what their files hold; ``stream`` is the file's name.

    Pieces that are written already are left out, and those behind the first
    failure or gap (live, failures are holes, which take an index and no bytes).
    """
    spark = pieces.sparkSession
    spark.dataSource.register(OrderedFiles)
    os.makedirs(path, exist_ok=True)
    rows = pieces.select("stream", F.col("idx").cast("long").alias("idx"), "ok", "data")
    if any(n.name.endswith(STATE) for n in os.scandir(path)):
        told = _told(path)(F.col("stream"))  # once a stream in each task, where its pieces come together anyway
        rows = rows.repartition("stream").withColumn("_told", told).select("*", F.col("_told.next_idx").alias("next_idx"), F.col("_told.offset").alias("offset")).drop("_told").filter("idx >= next_idx")
    else:
        rows = rows.withColumns({"next_idx": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    if live:
        rows = rows.withColumns({"data": F.when(F.col("ok"), F.col("data")), "ok": F.lit(True)})
    rows = committed(rows.withColumn("idx", F.col("idx") - F.col("next_idx")).withColumnRenamed("stream", "stream_id")).withColumnRenamed("stream_id", "stream")
    order = Window.partitionBy("stream").orderBy("idx")
    size = F.coalesce(F.octet_length("data"), F.lit(0)).cast("long")
    rows = rows.withColumn("offset", F.col("offset") + F.sum(size).over(order) - size).withColumn("idx", F.col("idx") + F.col("next_idx"))
    rows = rows.select("stream", "idx", "offset", "data").repartitionByRange("stream", "idx").sortWithinPartitions("stream", "idx")
    rows.write.format("ordered_files").mode("append").save(path)


def stream_into(pieces: DataFrame, path: str, checkpoint: str, live: bool = True, patience_s: float = 0.0, **trigger) -> StreamingQuery:
    """Start a query that puts the pieces (stream, idx, ok, data) of a stream of batches, in any order, into their files.

    Pieces are put in order, and their places counted, as keyed state (see
    ``ordering.in_order``); files of an earlier run go on only with its checkpoint.
    """
    spark = pieces.sparkSession
    ordering.use_rocksdb(spark)
    spark.dataSource.register(OrderedFiles)
    os.makedirs(path, exist_ok=True)
    placed = ordering.in_order(pieces.select("stream", "idx", "ok", "data"), live, patience_s, "stream", "data")
    rows = placed.select("stream", "idx", "offset", F.when(~F.col("hole"), F.col("data")).alias("data"))
    out = rows.writeStream.format("ordered_files").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()


class FileSink:
    """``write`` is for ``foreachBatch``: a batch that comes again finds its pieces written and adds nothing."""

    def __init__(self, path: str, live: bool = False):
        self.path, self.live = path, live

    def write(self, batch: DataFrame, batch_id: int) -> None:
        append(batch, self.path, self.live)
