"""Byte-level transforms of media segments.

Block ciphers come from Spark's own AES functions; only XOR over byte strings and
box parsing are batch UDFs, as Spark has no such functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def views_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary Arrow array, without a copy, and its rows' borders in them."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, borders, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, kind)
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(borders, kind)[column.offset : column.offset + len(column) + 1]


def binary_array(data: np.ndarray, borders: np.ndarray, null: np.ndarray) -> pa.Array:
    """A binary Arrow array over bytes and borders, without a copy."""
    valid = pa.array(~null).buffers()[1] if null.any() else None
    wide = borders[-1] >= 1 << 31
    return pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(null), [valid, pa.py_buffer(borders.astype(np.int64 if wide else np.int32)), pa.py_buffer(data)])


def by_row(f: Callable[..., bytes | None], *columns: pa.Array) -> pa.Array:
    """What ``f`` makes of each row's bytes; null where a column is. A row is an object only while it is worked on, so a batch takes its own bytes and those of the result."""
    null = np.logical_or.reduce([np.asarray(c.is_null()) for c in columns])
    views = [views_of(c) for c in columns]
    out, borders = bytearray(), np.zeros(len(null) + 1, np.int64)
    for i in range(len(null)):
        made = None if null[i] else f(*[x[at[i] : at[i + 1]].tobytes() for x, at in views])
        null[i] = made is None
        out += made or b""
        borders[i + 1] = len(out)
    return binary_array(np.frombuffer(out, np.uint8), borders, null)


@F.arrow_udf(T.BinaryType())
def xor_bytes(a: pa.Array, b: pa.Array) -> pa.Array:
    """a XOR b, as long as a; b must be as long at least. No row is an object of its own: a batch takes its own bytes and as many for the result."""
    null = np.asarray(a.is_null()) | np.asarray(b.is_null())
    (x, x_at), (y, y_at) = views_of(a), views_of(b)
    borders = np.concatenate([[0], np.cumsum(np.where(null, 0, np.diff(x_at)), dtype=np.int64)])
    out = np.empty(borders[-1], np.uint8)
    for i in np.flatnonzero(~null).tolist():
        n = borders[i + 1] - borders[i]
        np.bitwise_xor(x[x_at[i] : x_at[i + 1]], y[y_at[i] : y_at[i + 1]][:n], out=out[borders[i] : borders[i + 1]])
    return binary_array(out, borders, null)


def _block(block: Column, key: Column) -> Column:
    """One AES block: the first 16 bytes of ECB with padding."""
    return F.substring(F.aes_encrypt(block, key, F.lit("ECB"), F.lit("PKCS")), 1, 16)


def sequence_iv(seq: Column) -> Column:
    """The IV that a media sequence number stands for."""
    return F.unhex(F.lpad(F.hex(seq.cast("bigint")), 32, "0"))


def cbc_decrypt(data: Column, key: Column, iv: Column) -> Column:
    """AES-128-CBC of whole blocks without touching padding; bytes after the last whole block go.

    Spark's CBC wants padding, so a block that decrypts to padding is put behind:
    the encryption of (sixteen 16s XOR the last block).
    """
    whole = (F.floor(F.octet_length(data) / 16) * 16).cast("int")
    body = F.substr(data, F.lit(1), whole)
    last = F.when(whole > 0, F.substr(data, whole - 15, F.lit(16))).otherwise(iv)
    padding = _block(xor_bytes(F.unhex(F.lit("10" * 16)), last), key)
    return F.aes_decrypt(F.concat(iv, body, padding), key, F.lit("CBC"), F.lit("PKCS"))


def without_padding(data: Column) -> Column:
    """PKCS7 padding taken off if it is well-formed, else the bytes as they are."""
    n = F.conv(F.hex(F.substring(data, -1, 1)), 16, 10).cast("int")
    size = F.octet_length(data)
    tail = F.hex(F.substr(data, size - n + 1, n))
    good = (size > 0) & n.between(1, 16) & (n <= size) & (tail == F.repeat(F.lpad(F.hex(n.cast("bigint")), 2, "0"), n))
    return F.when(F.coalesce(good, F.lit(False)), F.substr(data, F.lit(1), size - n)).otherwise(data)


def segment_decrypt(data: Column, key: Column, iv: Column, seq: Column) -> Column:
    """A whole segment under AES-128: the key's IV or else the sequence number's, padding taken off where it is right."""
    return without_padding(cbc_decrypt(data, key, F.coalesce(iv, sequence_iv(seq))))


@F.pandas_udf(T.BinaryType())
def counter_blocks(iv: pd.Series, size: pd.Series) -> pd.Series:
    """As many counter blocks as ``size`` bytes need, one at least; the counter is the low 8 bytes and starts over after its greatest value."""

    def blocks(start: bytes | None, n: int | None) -> bytes | None:
        if start is None or n is None or n != n:
            return None
        high, low = (int.from_bytes(start.ljust(16, b"\0")[i : i + 8], "big") for i in (0, 8))
        out = np.full((max(1, -(-int(n) // 16)), 2), high, ">u8")
        out[:, 1] = np.uint64(low) + np.arange(len(out), dtype=np.uint64)
        return out.tobytes()

    return pd.Series([blocks(*x) for x in zip(iv, size, strict=True)], dtype=object)


def counter_stream(key: Column, iv: Column, size: Column) -> Column:
    """AES-CTR key stream of at least ``size`` bytes; ``iv`` of 8 bytes is filled with zeros, the counter is its low 8 bytes."""
    # all blocks in one call; the padding block that ECB adds lies behind them
    return F.aes_encrypt(counter_blocks(iv, size), key, F.lit("ECB"), F.lit("PKCS"))


def ctr_decrypt(data: Column, key: Column, iv: Column) -> Column:
    """AES-CTR over all of ``data``."""
    return xor_bytes(data, counter_stream(key, iv, F.octet_length(data)))


@F.arrow_udf(T.BinaryType())
def without_image_header(data: pa.Array) -> pa.Array:
    """Segments that hide behind an image header, from their first TS packet or box on."""
    magic = (b"\x89PNG", b"\xff\xd8\xff", b"GIF8", b"BM")

    def strip(x: bytes) -> bytes:
        if not x.startswith(magic):
            return x
        b = np.frombuffer(x, np.uint8)
        if len(b) > 376:
            sync = np.flatnonzero((b[:-376] == 0x47) & (b[188:-188] == 0x47) & (b[376:] == 0x47))
            if len(sync):
                return x[int(sync[0]) :]
        at = min((i for i in (x.find(t) for t in (b"ftyp", b"styp", b"moof", b"sidx")) if i >= 4), default=0)
        return x[at - 4 :] if at else x

    x, at = views_of(data)
    hidden = any(x[a : min(a + 4, z)].tobytes().startswith(magic) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
    return by_row(strip, data) if hidden else data


#: Boxes that hold boxes.
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"moof", b"traf", b"mvex", b"edts", b"sinf", b"schi")


def box_spans(b: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int, int]]:
    """type, place, payload start and end of the boxes in a stretch.

    Sizes of 32 and 64 bits and up to the end; a box that doesn't fit ends the walk.
    """
    while start + 8 <= end:
        size, head = int.from_bytes(b[start : start + 4], "big"), 8
        if size == 1:
            size, head = int.from_bytes(b[start + 8 : start + 16], "big"), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield b[start + 4 : start + 8], start, start + head, start + size
        start += size


def _walk(b: bytes, start: int, end: int, path: str) -> Iterator[tuple]:
    for kind, at, first, last in box_spans(b, start, end):
        name, inside = kind.decode("latin-1"), kind in CONTAINERS
        yield f"{path}/{name}", name, at, last - at, None if inside else b[first:last]
        if inside:
            yield from _walk(b, first, last, f"{path}/{name}")


def boxes(segments: DataFrame, data: str = "data") -> DataFrame:
    """id, path, type, at, size, payload: every box of ISO media (id, data), containers before what they hold."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, b in zip(frame["id"], frame["data"], strict=True):
                rows = [(i, *x) for x in _walk(b, 0, len(b), "")] if b is not None else []
                yield pd.DataFrame(rows, columns=["id", "path", "type", "at", "size", "payload"])

    return segments.select("id", F.col(data).alias("data")).mapInPandas(split, "id long, path string, type string, at long, size long, payload binary")


@F.pandas_udf(T.BinaryType())
def media_of(data: pd.Series) -> pd.Series:
    """The payloads of a segment's mdat boxes in a row; null without any."""

    def joined(b: bytes | None) -> bytes | None:
        found = [x[4] for x in _walk(b, 0, len(b), "") if x[1] == "mdat"] if b is not None else []
        return b"".join(found) if found else None

    return data.map(joined)


def media_data(segments: DataFrame) -> DataFrame:
    """id, body: the mdat payloads of each segment (id, data) that has any, put together in its row."""
    return segments.select("id", media_of("data").alias("body")).filter("body IS NOT NULL")


def _found(b: bytes, start: int, end: int, *path: bytes) -> Iterator[tuple[int, int]]:
    """Payloads of the boxes at a path."""
    for kind, _, first, last in box_spans(b, start, end):
        if kind == path[0]:
            if path[1:]:
                yield from _found(b, first, last, *path[1:])
            else:
                yield first, last


#: What may lie between a sample entry's head and its boxes: of video, of audio in its three versions, nothing.
ENTRY_HEADS = (78, 28, 44, 36, 8)
_BOX_TYPE = re.compile(rb"[A-Za-z0-9 ]{4}")


def tiles(b: bytes, start: int, end: int) -> bool:
    """Whether boxes fill a stretch to the byte."""
    while start < end:
        size = int.from_bytes(b[start : start + 4], "big")
        if size == 1 and start + 16 <= end:
            size = int.from_bytes(b[start + 8 : start + 16], "big")
        if start + 8 > end or size < 8 or start + size > end or not _BOX_TYPE.fullmatch(b, start + 4, start + 8):
            return False
        start += size
    return True


def entry_boxes(b: bytes, first: int, last: int) -> int | None:
    """Where a sample entry's boxes begin: at the first known head after which boxes tile it exactly and a sinf is among them, else at the first with any tiling."""
    fits = [first + head for head in ENTRY_HEADS if first + head <= last and tiles(b, first + head, last)]
    return next((at for at in fits if any(kind == b"sinf" for kind, *_ in box_spans(b, at, last))), fits[0] if fits else None)


def _tracks(b: bytes) -> Iterator[tuple]:
    """track, scheme, kid, iv_size, crypt, skip, constant_iv of the encrypted tracks of an init segment."""
    for track, (x, y) in enumerate(_found(b, 0, len(b), b"moov", b"trak")):
        entries = [e for s, t in _found(b, x, y, b"mdia", b"minf", b"stbl", b"stsd") for e in box_spans(b, s + 8, t)]
        for kind, _, first, last in entries:
            if kind not in (b"encv", b"enca"):
                continue
            inside = entry_boxes(b, first, last)
            if inside is None:
                continue
            tenc = next(_found(b, inside, last, b"sinf", b"schi", b"tenc"), None)
            if tenc is None or tenc[1] - tenc[0] < 24:
                continue
            schm = next(_found(b, inside, last, b"sinf", b"schm"), None)
            scheme = b[schm[0] + 4 : schm[0] + 8].decode("latin-1") if schm else "cenc"
            t = b[tenc[0] : tenc[1]]
            pattern = t[5] if t[0] > 0 else 0
            constant = bytes(t[25 : 25 + t[24]]) if t[6] == 1 and t[7] == 0 and len(t) > 24 else None
            yield track, scheme, bytes(t[8:24]), t[7], pattern >> 4, pattern & 15, constant
            break


def protection(inits: DataFrame) -> DataFrame:
    """id, track (from 0), scheme, kid, iv_size, crypt, skip, constant_iv of the encrypted tracks of init segments (id, data).

    Of a track's sample entries the first encrypted one with a whole tenc box counts; the
    scheme is cenc unless an schm says otherwise. Other data and null have no rows.
    """
    names = ["id", "track", "scheme", "kid", "iv_size", "crypt", "skip", "constant_iv"]

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, *x) for i, b in zip(frame["id"], frame["data"], strict=True) if b is not None for x in _tracks(b)]
            yield pd.DataFrame(rows, columns=names)

    kind = inits.schema["id"].dataType.simpleString()
    return inits.select("id", "data").mapInPandas(look, f"id {kind}, track int, scheme string, kid binary, iv_size int, crypt int, skip int, constant_iv binary")


def counting() -> Column:
    """Packets that count: with payload, and no null packets."""
    return F.col("afc").isin(1, 3) & (F.col("pid") != 0x1FFF)


def continuity(packets: DataFrame) -> DataFrame:
    """TS packets (stream, segment, pkt_no, pid, afc, cc) with ``out_cc``: a counter of 16 for each PID's payload packets that goes on over segments.

    Null packets and packets without payload keep their counter.
    """
    counts = counting()
    earlier = Window.partitionBy("_st", "_pid").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    sizes = packets.filter(counts).groupBy(F.col("stream").alias("_st"), F.col("pid").alias("_pid"), F.col("segment").alias("_seg")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_st", "_pid", "_seg", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("stream", "pid", "segment", counts).orderBy("pkt_no")) - 1
    rows = packets.withColumn("_within", within)
    rows = rows.join(before, F.col("stream").eqNullSafe(F.col("_st")) & (F.col("pid") == F.col("_pid")) & F.col("segment").eqNullSafe(F.col("_seg")), "left")
    out = F.when(counts, ((F.col("_before") + F.col("_within")) % 16).cast("int")).otherwise(F.col("cc"))
    return rows.withColumn("out_cc", out).drop("_st", "_pid", "_seg", "_before", "_within")
