"""Polling live playlists: ``spark.readStream.format("live")`` (see ``register``).

Options: ``streams`` (a line each: id, tab, URL), ``state`` (a folder that driver and
executors share), ``snapshots`` (instead of fetching: a Parquet folder of recorded
refreshes ``stream_id, n, url, body``, by ``n=``, a task a file), ``refreshes`` (end after so many),
``interval`` (seconds until a body says otherwise, 4), ``headers``, ``retries``,
``timeout``, ``per_task`` (streams that a task asks one after the other).

Offsets are refresh numbers. A refresh asks the streams that are due by their own
interval, which follows each body: half a playlist's target duration, a manifest's
update period. A stream whose refresh failed is asked again after the same time, for
ever; one that isn't live any more isn't asked again. What tasks learn of a stream
goes, a line each, into ``state``, as does what a refresh was planned to ask, so that
a refresh repeated after a failure asks the same streams.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..plans import segments
from ..sources import fetch, resolver
from . import live

SCHEMA = "stream_id string, n long, url string, body string, live boolean, refresh_s double, status int, error string"
#: Seconds between refreshes where no body has said.
INTERVAL = 4.0
_ARROW = pa.schema([("stream_id", pa.string()), ("n", pa.int64()), ("url", pa.string()), ("body", pa.string()), ("live", pa.bool_()), ("refresh_s", pa.float64()), ("status", pa.int32()), ("error", pa.string())])


def _seconds(text: str | None) -> float:
    """An ISO 8601 duration of days and less, or with years of 365.25 and months of 30 days."""
    found = re.fullmatch(r"P(?:([\d.]+)Y)?(?:([\d.]+)M)?(?:([\d.]+)D)?(?:T(?:([\d.]+)H)?(?:([\d.]+)M)?(?:([\d.]+)S)?)?", text or "")
    return sum(float(x or 0) * unit for x, unit in zip(found.groups(), (31557600, 2592000, 86400, 3600, 60, 1), strict=True)) if found else 0.0


def told(body: str) -> tuple[bool, float]:
    """Whether a playlist or manifest is live, and the seconds until it wants to be asked again (0 if it doesn't say)."""
    if "#EXTM3U" in body[:64]:
        target = re.search(r"^#EXT-X-TARGETDURATION:\s*([\d.]+)", body, re.M)
        live = not re.search(r"^#EXT-X-ENDLIST", body, re.M)
        return live, float(target[1]) / 2 if live and target else 0.0
    root = re.search(r"<MPD\b[^>]*>", body)


    def given(name: str) -> str | None:
        found = re.search(rf"\b{name}\s*=\s*[\"']([^\"']*)", root[0])
        return found and found[1]

    if not root or given("type") != "dynamic":
        return False, 0.0
    return True, _seconds(given("minimumUpdatePeriod")) or max(_seconds(given("timeShiftBufferDepth")) / 2, 2.0)


def _store(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Ask(InputPartition):
    def __init__(self, n: int, streams: list[tuple[str, str]], at: int):
        super().__init__((n, streams, at))


class LiveReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        o = options.get
        self.streams = dict(line.split("\t", 1) for line in o("streams", "").splitlines() if "\t" in line)
        self.snapshots, self.state = o("snapshots"), o("state")
        if not self.state:
            raise ValueError("option state: a folder that driver and executors share")
        self.refreshes = int(o("refreshes", "-1"))
        self.interval = float(o("interval", str(INTERVAL)))
        pairs = [line.partition(":") for line in o("headers", "").splitlines() if ":" in line]
        self.headers = {name.strip(): value.strip() for name, _, value in pairs}
        self.retries, self.timeout, self.per_task = int(o("retries", "5")), float(o("timeout", "30")), int(o("per_task", "1"))
        #: stream: (seconds, live, when it was asked)
        self.known: dict[str, tuple[float, bool, float]] = {}
        self.read_upto, self.asked_at = 0, 0.0

    # what is kept in ``state``: plan-<n>, with the streams of a refresh, and told-<n>-<task>

    def _write(self, name: str, rows: list) -> None:
        """Whole or not at all; a second attempt replaces the first."""
        store, path = _store(self.state)
        store.create_dir(path, recursive=True)
        temporary = f"{path}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as f:
            f.write(json.dumps(rows).encode())
        store.move(temporary, f"{path}/{name}")

    def _read(self, name: str) -> list | None:
        store, path = _store(self.state)
        try:
            with store.open_input_file(f"{path}/{name}") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def _learn(self, upto: int) -> None:
        """Take in what the refreshes before ``upto`` told."""
        for n in range(self.read_upto, upto):
            plan = self._read(f"plan-{n}")
            for at in range(len(plan or ())):
                for stream, live, seconds, when in self._read(f"told-{n}-{at}") or ():
                    before = self.known.get(stream, (self.interval, True, 0.0))[0]
                    self.known[stream] = (seconds or before, live, when)
        self.read_upto = upto

    def _due(self, now: float) -> list[tuple[str, str]]:
        new = (self.interval, True, 0.0)
        return [(s, url) for s, url in sorted(self.streams.items()) if (k := self.known.get(s, new))[1] and k[2] + k[0] <= now]

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        """One refresh further if a stream is due."""
        n = self.read_upto
        while self._read(f"plan-{n}") is not None:  # planned, in this run or an earlier one
            n += 1
        if self.refreshes >= 0 and n >= self.refreshes:
            return {"n": n}
        if self.snapshots:
            tasks = self._files(n)
        else:
            self._learn(n)
            now = time.time()
            due = self._due(now)
            if not due:
                return {"n": n}
            tasks = [due[i : i + self.per_task] for i in range(0, len(due), self.per_task)]
        self._write(f"plan-{n}", tasks)
        return {"n": n + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Ask(n, [tuple(s) for s in streams], at) for n in range(start["n"], end["n"]) for at, streams in enumerate(self._read(f"plan-{n}") or ())]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        n, streams, at = partition.value
        if self.snapshots:  # their plan doesn't depend on what a body says of its stream
            yield from self._recorded(n, streams)
            return
        about = []
        for stream, url, body, status, error in self._fetched(streams):
            live, seconds = told(body) if body is not None else (True, 0.0)
            about.append((stream, live, seconds, time.time()))
            yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, (stream, n, url, body, live, seconds, status, error), strict=True))], schema=_ARROW)
        self._write(f"told-{n}-{at}", about)

    def _fetched(self, streams: list[tuple[str, str]]) -> Iterator[tuple]:
        for stream, url in streams:
            final, status, body, _, _, error = fetch.get(url, None, self.headers, "GET", self.retries, self.timeout)
            yield stream, final or url, None if body is None else body.decode("utf-8", "replace"), status, error

    def _files(self, n: int) -> list[list[tuple[str, str]]]:
        """The files of a recorded refresh, a task each."""
        from pyarrow import fs

        store, path = _store(self.snapshots)
        found = store.get_file_info(fs.FileSelector(f"{path}/n={n}", allow_not_found=True, recursive=True))
        names = sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
        return [[(name, "")] for name in names]

    def _recorded(self, n: int, names: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        store, _ = _store(self.snapshots)
        for name, _ in names:
            for batch in ds.dataset(name, format="parquet", filesystem=store).to_batches(columns=["stream_id", "url", "body"], batch_size=256):
                rows = []
                for row in batch.to_pylist():
                    body = row["body"]
                    live, seconds = told(body) if body is not None else (True, 0.0)
                    status, error = (200, "") if body is not None else (0, "not recorded")
                    rows.append(dict(zip(_ARROW.names, (str(row["stream_id"]), n, row["url"], body, live, seconds, status, error), strict=True)))
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    def commit(self, end: dict) -> None:
        if not self.snapshots:
            self._learn(end["n"])


class LiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "live"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LiveReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LiveSource)


class Feed:
    """Follow live streams: one query fetches refreshes and writes down their segments, another gives what is new.

    ``known``: stream_id (string), id (that of a track in a DASH manifest; null for
    playlists). ``path``: a shared folder for segments, state and checkpoints; a
    feed that is started again with it goes on where it was. ``options`` are those
    of the source. Unless ``from_start``, of a live stream's first refresh only the
    newest ``keep`` segments count as new, and those before them never do.
    """

    def __init__(self, spark: SparkSession, known: DataFrame, path: str, options: dict[str, str], from_start: bool = False, keep: int = 3):
        register(spark)
        self.spark, self.known, self.path, self.options = spark, known, path.rstrip("/"), {"state": f"{path.rstrip('/')}/told", **options}
        self.from_start, self.keep = from_start, keep

    SEGMENTS = "stream_id string, n long, seg_ord long, url string, duration double, range struct<start:bigint,end:bigint>, live boolean, lost boolean"

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """Segments of a batch of refreshes; a batch that comes again replaces what it wrote. Streams that a manifest lost, and failed fetches, have a row without URL."""
        raw = f"{self.path}/refreshes/batch={batch_id}"
        batch.write.mode("overwrite").parquet(raw)  # what is read of a batch more than once would be fetched more than once
        batch = self.spark.read.schema(SCHEMA).parquet(raw)
        key = F.concat_ws("\t", "stream_id", F.col("n").cast("string")).alias("manifest_id")
        bodies = batch.filter("body IS NOT NULL").select(key, "url", "body")
        asked = batch.select("stream_id", "n", "live", key)
        ids = asked.join(self.known.select("stream_id", "id"), "stream_id").select("manifest_id", "id")
        kinds = tuple(r[0] for r in bodies.select(resolver.kind_of(F.col("body"))).distinct().collect())  # three at most
        found = resolver.refreshed(ids, bodies, kinds=kinds).drop("id")
        rows = asked.join(found, "manifest_id", "left").select("stream_id", "n", "seg_ord", "url", "duration", "range", "live", F.coalesce("lost", F.lit(True)).alias("lost"))
        rows.write.mode("overwrite").parquet(f"{self.path}/segments/batch={batch_id}")

    def refreshing(self, **trigger) -> StreamingQuery:
        """Start to fetch. ``trigger`` as for ``DataStreamWriter.trigger``."""
        source = self.spark.readStream.format("live").options(**self.options).load()
        out = source.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.path}/fetching")
        return (out.trigger(**trigger) if trigger else out).start()

    def backlog(self) -> DataFrame:
        """stream_id, _piece: what the first refresh of a live stream had before its newest segments."""
        first = self.spark.read.schema(self.SEGMENTS).parquet(f"{self.path}/segments/batch=*").filter("n = 0 AND live AND NOT lost")
        place = F.row_number().over(Window.partitionBy("stream_id").orderBy(F.col("seg_ord").desc()))
        return first.withColumn("_n", place).filter(F.col("_n") > self.keep).select("stream_id", segments.fetch_key().alias("_piece")).distinct()

    def fresh(self, patterns: list[str] | None = None) -> DataFrame:
        """A stream of new segments (see ``live.fresh_segments``), once the first refresh is in: each the first time that a refresh has it."""
        rows = self.spark.readStream.schema(self.SEGMENTS).parquet(f"{self.path}/segments/batch=*").filter("NOT lost")
        if not self.from_start:
            rows = rows.withColumn("_piece", segments.fetch_key()).join(self.backlog(), ["stream_id", "_piece"], "left_anti").drop("_piece")
        return live.fresh_segments(rows, patterns)
