"""Order and ends of live streams as keyed state: pieces that come out of order, streams that end, counters that run on.

The processors keep their state in the session's state store, which must be RocksDB's
(``use_rocksdb``); a batch that is run again finds the state as it was before it.
"""

from __future__ import annotations

import pickle
import threading
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Queries that are started from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


#: So many pieces' places make a run, which is one value of the state; pieces above ``OWN_BYTES`` have values of their own.
RUN, OWN_BYTES = 256, 1 << 14


class _Waiting:
    """The pieces of one key that wait, by index. What a batch needs of them is read and written by runs, not piece by piece."""

    def __init__(self, stored, own, there: list[int]):
        self.stored, self.own, self.there = stored, own, set(there)
        self.runs: dict[int, dict[int, tuple | None]] = {}  # None: the piece has a value of its own
        self.changed: set[int] = set()

    def _run(self, idx: int) -> dict[int, tuple | None]:
        n = idx // RUN
        if n not in self.runs:
            self.runs[n] = pickle.loads(self.stored.getValue((n,))[0]) if n in self.there else {}
        return self.runs[n]

    def __contains__(self, idx: int) -> bool:
        return idx in self._run(idx)

    def get(self, idx: int) -> tuple:
        row = self._run(idx)[idx]
        return pickle.loads(self.own.getValue((idx,))[0]) if row is None else row

    def put(self, idx: int, row: tuple) -> None:
        large = sum(len(x) for x in row if isinstance(x, (bytes, str))) > OWN_BYTES
        if large:
            self.own.updateValue((idx,), (pickle.dumps(row),))
        elif self._run(idx).get(idx, row) is None:
            self.own.removeKey((idx,))
        self._run(idx)[idx] = None if large else row
        self.changed.add(idx // RUN)

    def pop(self, idx: int) -> tuple:
        row = self.get(idx)
        if self._run(idx).pop(idx) is None:
            self.own.removeKey((idx,))
        self.changed.add(idx // RUN)
        return row

    def places(self) -> list[int]:
        """All indexes, in order."""
        return sorted(i for n in self.there | self.runs.keys() for i in self._run(n * RUN))

    def save(self) -> list[int]:
        """Write down what has changed; the runs that are there."""
        for n in self.changed:
            if self.runs[n]:
                self.stored.updateValue((n,), (pickle.dumps(self.runs[n]),))
                self.there.add(n)
            elif n in self.there:
                self.stored.removeKey((n,))
                self.there.remove(n)
        self.changed.clear()
        return sorted(self.there)


class _Reorder(StatefulProcessor):
    def __init__(self, key: str, carried: list[tuple[str, str]], live: bool, patience_s: float, sized: str | None):
        self.key, self.carried, self.live, self.patience_ms = key, carried, live, int(patience_s * 1000)
        self.sized = [c for c, _ in carried].index(sized) if sized else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "idx long, offset long, runs array<long>")
        self.stored = handle.getMapState("runs", "n long", "pieces binary")
        self.own = handle.getMapState("own", "idx long", "piece binary")

    def _known(self) -> tuple[int, int, _Waiting]:
        at, offset, runs = self.place.get() or (0, 0, [])
        return at, offset, _Waiting(self.stored, self.own, runs)

    def _out(self, key, rows: list[tuple], begin: int) -> tuple[pd.DataFrame, int]:
        """The rows, and where their stream's file ends behind them."""
        out = pd.DataFrame([(key, idx, not ok, *rest) for idx, ok, *rest in rows], columns=[self.key, "idx", "hole", *(c for c, _ in self.carried)])
        if self.sized is not None:
            ends = list(accumulate((len(rest[self.sized] or b"") if ok else 0 for _, ok, *rest in rows), initial=begin))
            out["offset"], begin = ends[:-1], ends[-1]
        return out, begin

    @staticmethod
    def _follow(waiting: _Waiting, at: int, out: list[tuple]) -> int:
        """Take the waiting pieces from ``at`` on."""
        while at in waiting:
            out.append((at, *waiting.pop(at)))
            at += 1
        return at

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, offset, waiting = self._known()
        names = ["idx", "ok", *(c for c, _ in self.carried)]
        new = [row for frame in rows for row in frame[names].itertuples(index=False, name=None)]
        if not self.live:
            new = [row for row in new if row[1]]  # a failure is no result; the piece may still come
        new.sort(key=lambda row: (row[0], not row[1]))
        out, held = [], not at
        for idx, ok, *rest in new:
            if idx == at:
                out.append((at, bool(ok), *rest))
                at = self._follow(waiting, at + 1, out)
            elif idx > at and not (idx in waiting and waiting.get(idx)[0]):
                waiting.put(idx, (bool(ok), *rest))
                held = True
        frame, offset = self._out(key[0], out, offset)
        self.place.update((at, offset, waiting.save()))
        if self.live and self.patience_ms and held and not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        if out:
            yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What was waited for has become a hole."""
        at, offset, waiting = self._known()
        places = waiting.places()
        if not places:
            return
        out = [(i, False, *[None] * len(self.carried)) for i in range(at, places[0])]
        n_holes = len(out)
        at = self._follow(waiting, places[0], out)
        frame, offset = self._out(key[0], out, offset)
        self.place.update((at, offset, waiting.save()))
        if len(places) > len(out) - n_holes:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        yield frame

    def close(self) -> None:
        pass


def in_order(outcomes: DataFrame, live: bool = True, patience_s: float = 0.0, key: str = "stream_id", sized: str | None = None) -> DataFrame:
    """Outcomes (``key``, idx from 0, ok, more columns) of a stream of batches in any order, as they are committed: ``key``, idx, hole, the other columns.

    A piece is given once all before it are. Live, one that failed is a hole, and
    so is one that isn't there ``patience_s`` after a later one came (0: it is
    waited for). Else a failed piece holds up what follows until it comes after
    all. Pieces that come twice, or after their hole, are left out. What waits is
    kept by stream and runs of places. With ``sized``, the name of a binary column, ``offset``
    tells where a piece begins in its stream's file; holes have no bytes.
    """
    carried = [(c, kind) for c, kind in outcomes.dtypes if c not in (key, "idx", "ok")]
    kinds = dict(outcomes.dtypes)
    schema = ", ".join([f"`{key}` {kinds[key]}", "idx long", "hole boolean", *(f"`{c}` {kind}" for c, kind in carried), *(["offset long"] if sized else [])])
    rows = outcomes.withColumn("idx", F.col("idx").cast("long"))
    mode = "ProcessingTime" if live and patience_s else "None"
    return rows.groupBy(key).transformWithStateInPandas(_Reorder(key, carried, live, patience_s, sized), schema, "Append", mode)


#: Streams are dealt into so many groups, each a call of Python and a value of the state for all of its streams.
GROUPS = 1024


class _Ending(StatefulProcessor):
    """The streams of a group: seconds taken, last n, whether ended, and when the clock ends them (0: never)."""

    def __init__(self, limit_s: float, clock_s: float):
        self.limit_s, self.clock_ms = limit_s, int(clock_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("streams", "streams binary")

    def _known(self) -> dict:
        return pickle.loads(found[0]) if (found := self.state.get()) else {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, out = self._known(), []
        until = timerValues.getCurrentProcessingTimeInMs() + self.clock_ms if self.clock_ms else 0
        new = pd.concat(rows)[["nameless", "stream_id", "n", "duration", "live", "asked_to_stop"]].sort_values("n", kind="stable").fillna({"duration": 0.0})
        begun = False
        for nameless, stream, n, duration, live, asked in zip(*(new[c].tolist() for c in new), strict=True):
            stream = None if nameless else stream
            if stream not in known:
                known[stream], begun = (0.0, -1, False, until), True
            taken, _, ended, clock = known[stream]
            if not ended:
                taken += duration
                ended = bool((self.limit_s > 0 and taken >= self.limit_s) or not live or asked)
                known[stream] = (taken, n, ended, clock)
                out.append((stream, n, duration, ended))
        self.state.update((pickle.dumps(known),))
        if begun and self.clock_ms:
            self.handle.registerTimer(until)
        if out:
            yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, at = self._known(), expiredTimerInfo.getExpiryTimeInMs()
        out = [(stream, n, 0.0, True) for stream, (_, n, ended, clock) in known.items() if not ended and clock <= at]
        if out:
            self.state.update((pickle.dumps(known | {s: (*known[s][:2], True, known[s][3]) for s, *_ in out}),))
            yield self._rows(out)

    @staticmethod
    def _rows(out: list[tuple]) -> pd.DataFrame:
        streams, n, duration, last = zip(*out, strict=True)
        return pd.DataFrame({"stream_id": pd.Series(streams, dtype=object), "n": n, "duration": duration, "last": last})

    def close(self) -> None:
        pass


def until_stop(refreshes: DataFrame, limit_s: float, clock_s: float = 0.0) -> DataFrame:
    """The refreshes of a stream of batches that are still taken (see ``status.until_stop``): stream_id, n, duration, last.

    A stream's end is kept for good: whatever comes after it is left out. Its
    batches must come in the order of ``n``. ``clock_s`` seconds after its first
    refresh a stream ends in any case, with a row that repeats the last ``n`` with
    no duration (0: no such limit). The number of rows marked ``last`` is observed
    as ``ended`` (see ``StopWhenEnded``).
    """
    kind, stream = dict(refreshes.dtypes)["stream_id"], F.col("stream_id")
    named = F.coalesce(stream, F.lit(0).cast(kind)).alias("stream_id")  # no null among integers, which pandas would make floats of
    rows = refreshes.select(named, stream.isNull().alias("nameless"), F.col("n").cast("long").alias("n"), F.col("duration").cast("double").alias("duration"), "live", "asked_to_stop")
    mode = "ProcessingTime" if clock_s else "None"
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("stream_id"), F.lit(GROUPS)))
    taken = rows.groupBy("_group").transformWithStateInPandas(_Ending(limit_s, clock_s), f"stream_id {kind}, n long, duration double, last boolean", "Append", mode)
    return taken.observe("ended", F.count_if("last").alias("n"))


class StopWhenEnded(StreamingQueryListener):
    """Stops the query called ``name`` once ``streams`` of its streams have ended; ``already`` of them had when it was started."""

    def __init__(self, spark: SparkSession, name: str, streams: int, already: int = 0):
        self.spark, self.name, self.streams, self.already = spark, name, streams, already
        self.by_batch: dict[int, int] = {}

    @property
    def ended(self) -> int:
        return self.already + sum(self.by_batch.values())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        told = event.progress.observedMetrics.get("ended")
        if event.progress.name != self.name or told is None:
            return
        self.by_batch[event.progress.batchId] = told["n"]  # a batch that is run again counts once
        if self.ended >= self.streams and (query := self.spark.streams.get(str(event.progress.id))):
            threading.Thread(target=query.stop, daemon=True).start()  # a listener must not wait for its query

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class _Running(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.total.get()[0] if self.total.exists() else 0
        new = pd.concat(rows).sort_values("segment", kind="stable")
        sums = new["n"].cumsum() + before
        self.total.update((int(sums.iloc[-1]),))
        yield pd.DataFrame({"stream": key[0], "pid": key[1], "segment": new["segment"].to_numpy(), "before": (sums - new["n"]).to_numpy()})

    def close(self) -> None:
        pass


def running_starts(counts: DataFrame) -> DataFrame:
    """Of counts (stream, pid, segment, n) of a stream of batches, which come in the order of segments: stream, pid, segment, before (what came earlier).

    State is one number for each stream and PID.
    """
    kinds = dict(counts.dtypes)
    schema = f"stream {kinds['stream']}, pid int, segment {kinds['segment']}, before long"
    rows = counts.select("stream", F.col("pid").cast("int").alias("pid"), "segment", F.col("n").cast("long").alias("n"))
    return rows.groupBy("stream", "pid").transformWithStateInPandas(_Running(), schema, "Append", "None")
