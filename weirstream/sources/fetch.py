"""Fetching: ``spark.read.format("fetch")`` for a list of URLs, ``fetched`` for a table of requests.

Options of the source: ``urls`` (one a line, a byte range ``a-b`` behind a tab if
wanted), ``headers`` (``Name: value``, one a line), ``method`` (``get`` or
``head``), ``retries``, ``timeout``. Each URL is one partition, so fetching
spreads over executors and a lost one is fetched again. Local paths and file URLs
work as well. Long files are cut into ranges (``file_ranges``), and what a sink
already holds is left out (``missing``), so a download goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalars import RETRIABLE

#: ``length`` is what the server says of the body, ``pressure`` counts retriable statuses on the way.
REPLY = "final_url string, status int, body binary, length long, pressure int, error string"
SCHEMA = f"url string, {REPLY}"
#: A frame of replies goes on once its bodies have so many bytes.
FRAME_BYTES = 1 << 22


def wait_of(value: str | None, most: float = 30.0) -> float:
    """Seconds that a Retry-After header asks for, as a number or a date, ``most`` at most; 0 if it can't be read."""
    from datetime import UTC, datetime
    from email.utils import parsedate_to_datetime

    text = (value or "").strip()
    if text.lstrip("+-").isdigit():
        return float(min(most, max(0, int(text))))
    try:
        at = parsedate_to_datetime(text)
    except (TypeError, ValueError):
        return 0.0
    return min(most, max(0.0, ((at if at.tzinfo else at.replace(tzinfo=UTC)) - datetime.now(UTC)).total_seconds()))


def get(url: str, span: tuple[int, int] | None = None, headers: dict | None = None, method: str = "GET", retries: int = 5, timeout: float = 30.0) -> tuple:
    """The reply (see REPLY) to one request; a span's end of -1 is open.

    Retriable statuses, lost connections and bodies that break off are tried
    again, HEAD is not. After a break only what is missing is asked for. A whole
    file that comes instead of a range is cut to it.
    """
    import http.client
    import random
    import time
    import urllib.error
    import urllib.request

    address = url if "://" in url else f"file://{url}"
    first, last = span or (0, -1)
    if address.startswith("file:///") and "#" not in address and method != "HEAD":
        return _local(address, first, last)
    got, status, pressure, pause, error = bytearray(), 0, 0, 0.5, ""
    tries = 1 if method == "HEAD" else retries + 1
    for at in range(tries):
        request = urllib.request.Request(address, headers=headers or {}, method=method)  # noqa: S310
        if span or got:
            request.add_header("Range", f"bytes={first + len(got)}-{last if last >= 0 else ''}")
        wait = pause * (1 + random.random() / 2)  # noqa: S311
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:  # noqa: S310
                status = getattr(r, "status", None) or 200
                length = r.headers.get("Content-Length")
                length = int(length) if length and length.isdigit() else None
                if method == "HEAD":
                    return r.geturl(), status, None, length, pressure, ""
                if status != 206:  # the file from its beginning
                    got.clear()
                had = len(got)
                while piece := r.read(1 << 20):
                    got += piece
                if length is not None and len(got) - had < length:
                    raise ConnectionError("body breaks off")
                body = bytes(got)
                if span and status != 206:
                    body = body[first : last + 1 if last >= 0 else None]
                return r.geturl(), status, body, length, pressure, ""
        except urllib.error.HTTPError as e:
            status, error = e.code, f"HTTP {e.code}"
            if status not in RETRIABLE:
                break
            pressure += 1
            wait = wait_of(e.headers.get("Retry-After")) or wait
        except (OSError, http.client.HTTPException) as e:
            status, error = 0, str(e)
            if address.startswith("file:"):
                break
        if at + 1 < tries:
            time.sleep(wait)
            pause = min(8.0, pause * 2)
    return address, status, None, None, pressure, error


def _local(address: str, first: int, last: int) -> tuple:
    """The reply of a file, of which only the range is read."""
    import os
    import urllib.request

    try:
        with open(urllib.request.url2pathname(address.removeprefix("file://")), "rb") as f:
            f.seek(first)
            body = f.read(max(0, last + 1 - first) if last >= 0 else -1)
            return address, 200, body, os.fstat(f.fileno()).st_size, 0, ""
    except OSError as e:
        return address, 0, None, None, 0, str(e)


class _Request(InputPartition):
    def __init__(self, url: str, span: tuple[int, int] | None):
        super().__init__((url, span))


class FetchReader(DataSourceReader):
    def __init__(self, options: dict):
        lines = [u.strip() for u in options.get("urls", "").splitlines() if u.strip()]
        self.requests = [(url, self._span(span)) for url, _, span in (line.partition("\t") for line in lines)]
        pairs = [line.partition(":") for line in options.get("headers", "").splitlines() if ":" in line]
        self.headers = {name.strip(): value.strip() for name, _, value in pairs}
        self.method = options.get("method", "get").upper()
        self.retries, self.timeout = int(options.get("retries", "5")), float(options.get("timeout", "30"))

    @staticmethod
    def _span(text: str) -> tuple[int, int] | None:
        a, dash, b = text.strip().partition("-")
        return (int(a), int(b) if b else -1) if dash else None

    def partitions(self) -> list[InputPartition]:
        return [_Request(*r) for r in self.requests]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        url, span = partition.value
        yield url, *get(url, span, self.headers, self.method, self.retries, self.timeout)


class FetchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fetch"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FetchReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FetchSource)


def fetched(requests: DataFrame, retries: int = 5, timeout: float = 30.0) -> DataFrame:
    """Requests (url, span struct<start,end>, headers map) with their replies; bodies wait for one another up to ``FRAME_BYTES``.

    Null spans and headers ask for the whole file with none; a null url has no reply. A partition of
    requests is fetched one after the other: repartition them for more at a time.
    """

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, size = [], 0
            for url, span, headers in frame.itertuples(index=False):
                place = (int(span["start"]), int(span["end"])) if span is not None else None
                reply = get(url, place, dict(headers or {}), "GET", retries, timeout) if url is not None else (None,) * 6
                rows.append((url, span, *reply))
                size += len(reply[2] or b"")
                if size >= FRAME_BYTES:
                    yield pd.DataFrame(rows, columns=names, dtype=object)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names, dtype=object)

    schema = f"url string, span struct<start:bigint,end:bigint>, {REPLY}"
    names = [field.split()[0] for field in ("url x", "span x", *REPLY.split(", "))]
    return requests.select("url", F.col("span").cast("struct<start:bigint,end:bigint>").alias("span"), F.col("headers").cast("map<string,string>").alias("headers")).mapInPandas(load, schema)


def file_ranges(files: DataFrame, piece_bytes: int) -> DataFrame:
    """Files (stream_id, url, length) as pieces ``idx`` with their ``span``; one open piece where the length isn't known, none of empty files."""
    last = F.greatest(F.ceil(F.col("length") / piece_bytes).cast("long") - 1, F.lit(0).cast("long"))
    places = F.when(F.col("length").isNull(), F.array(F.lit(0).cast("long"))).when(F.col("length") > 0, F.sequence(F.lit(0).cast("long"), last))
    begin = F.col("idx") * piece_bytes
    end = F.coalesce(F.least(begin + piece_bytes, F.col("length")) - 1, F.lit(-1).cast("long"))
    end = F.when(F.col("length").isNull(), F.lit(-1).cast("long")).otherwise(end)
    return files.select("stream_id", "url", "length", F.explode(places).alias("idx")).select("stream_id", "url", "idx", F.struct(begin.alias("start"), end.alias("end")).alias("span"))


def missing(pieces: DataFrame, written: DataFrame) -> DataFrame:
    """Pieces (stream_id, idx) that aren't written yet."""
    return pieces.join(written.select("stream_id", "idx"), ["stream_id", "idx"], "left_anti")
