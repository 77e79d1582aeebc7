"""Common encryption of fragments: cenc, cens (counter), cbc1, cbcs (block chaining).

A fragment's tables say where its samples lie and which of their bytes are
encrypted. The ranges of one cipher run (a sample for counters, a subsample or
sample for chaining) are gathered inside the segment's row, go through Spark's AES
functions as an array, and are put back: nothing leaves the row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import binary

SAMPLES = "id long, sample int, at long, size long, iv binary, subsamples array<struct<clear:int,encrypted:bigint>>"


def _boxes(b: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """type, payload start, end of the boxes in a stretch."""
    return ((kind, first, last) for kind, _, first, last in binary.box_spans(b, start, end))


def _sizes(b: bytes, start: int, end: int) -> tuple[int | None, list[int]]:
    """Data offset and sample sizes of a trun; without sizes they are 0."""
    flags = int.from_bytes(b[start + 1 : start + 4], "big")
    count = int.from_bytes(b[start + 4 : start + 8], "big")
    at = start + 8
    offset = None
    if flags & 0x1:
        offset = struct.unpack(">i", b[at : at + 4])[0]
        at += 4
    at += 4 * bool(flags & 0x4)
    fields = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
    sizes = []
    for _ in range(count):
        row = dict(zip(fields, range(at, end, 4), strict=False))
        sizes.append(int.from_bytes(b[row[0x200] : row[0x200] + 4], "big") if 0x200 in row else 0)
        at += 4 * len(fields)
    return offset, sizes


def _explicit_base(b: bytes, start: int, end: int) -> int | None:
    """Base data offset of a tfhd; none where it has none or says that the moof is the base."""
    flags = int.from_bytes(b[start + 1 : start + 4], "big")
    if flags & 0x20000 or not flags & 0x1 or end - start < 16:
        return None
    return struct.unpack(">q", b[start + 8 : start + 16])[0]


def _entry(b: bytes, at: int, iv_size: int, split: bool) -> tuple[int, bytes, list[tuple[int, int]]]:
    """One sample's IV and subsamples, and where the next begins."""
    iv = b[at : at + iv_size]
    at += iv_size
    parts = []
    if split:
        n = int.from_bytes(b[at : at + 2], "big")
        parts = [struct.unpack(">HI", b[at + 2 + 6 * i : at + 8 + 6 * i]) for i in range(n)]
        at += 2 + 6 * n
    return at, iv, parts


def fragment_samples(b: bytes, iv_size: int) -> list[tuple]:
    """sample, at, size, iv, subsamples of the samples of every fragment in a segment.

    IVs come from senc, else from the auxiliary data that saiz and saio point to.
    Of several truns in a track fragment the last counts. Samples are placed from
    the moof, or from tfhd's base data offset, counted from the segment's start; if
    that leads outside the mdat that follows, a ValueError tells so.
    """
    out = []
    number = 0
    tops = list(_boxes(b, 0, len(b)))
    for n, (kind, start, end) in enumerate(tops):
        if kind != b"moof":
            continue
        moof = start - 8
        mdat = next(((x, y) for name, x, y in tops[n + 1 :] if name == b"mdat"), (end, end))
        for k, s, e in _boxes(b, start, end):
            if k != b"traf":
                continue
            inside = {name: (x, y) for name, x, y in _boxes(b, s, e)}
            if b"trun" not in inside:
                continue
            offset, sizes = _sizes(b, *inside[b"trun"])
            at = moof + offset if offset is not None else end + 8
            base = _explicit_base(b, *inside[b"tfhd"]) if b"tfhd" in inside else None
            if base is not None:
                at = base + (offset or 0)
                if at < mdat[0] or at + sum(sizes) > mdat[1]:
                    raise ValueError(f"samples at {at} of {sum(sizes)} bytes lie outside mdat ({mdat[0]} to {mdat[1]})")
            entries: list[tuple[bytes, list]] = []
            if b"senc" in inside:
                x, _ = inside[b"senc"]
                split, p = bool(b[x + 3] & 2), x + 8
                for _ in range(int.from_bytes(b[x + 4 : x + 8], "big")):
                    p, iv, parts = _entry(b, p, iv_size, split)
                    entries.append((iv, parts))
            elif b"saiz" in inside and b"saio" in inside:
                x, _ = inside[b"saiz"]
                x += 4 + 8 * (b[x + 3] & 1)
                same, count = b[x], int.from_bytes(b[x + 1 : x + 5], "big")
                y, _ = inside[b"saio"]
                wide = b[y] == 1
                y += 4 + 8 * (b[y + 3] & 1) + 4
                p = moof + int.from_bytes(b[y : y + (8 if wide else 4)], "big")
                for i in range(count):
                    size = same or b[x + 5 + i]
                    _, iv, parts = _entry(b, p, iv_size, size > iv_size)
                    entries.append((iv, parts))
                    p += size
            for i, size in enumerate(sizes):
                iv, parts = entries[i] if i < len(entries) else (b"", [])
                out.append((number, at, size, iv, [{"clear": c, "encrypted": n} for c, n in parts]))
                at += size
                number += 1
    return out


def samples(segments: DataFrame) -> DataFrame:
    """Samples (see SAMPLES) of segments (id, data, iv_size)."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, *x) for i, b, n in zip(frame["id"], frame["data"], frame["iv_size"], strict=True) if b is not None for x in fragment_samples(b, int(n))]
            yield pd.DataFrame(rows, columns=["id", "sample", "at", "size", "iv", "subsamples"])

    return segments.select("id", "data", "iv_size").mapInPandas(read, SAMPLES)


def _spots(start: int, length: int, crypt: int, skip: int, chained: bool) -> list[tuple[int, int]]:
    """Places and sizes of the encrypted bytes in a stretch; a pattern and chaining take whole blocks only."""
    striped = crypt > 0 and skip > 0
    found = [(start + o, min(crypt * 16, length - o)) for o in range(0, length, (crypt + skip) * 16)] if striped else [(start, length)]
    cut = [(at, n - n % 16 if striped or chained else n) for at, n in found]
    return [(at, n) for at, n in cut if n > 0]


CHAINED = ("cbc1", "cbcs")
_LONGS, _BYTES = T.ArrayType(T.LongType()), T.BinaryType()
_RUN = T.StructType([T.StructField("at", _LONGS), T.StructField("n", _LONGS), *[T.StructField(c, _BYTES) for c in ("iv", "body", "mask")]])


def _cipher_runs(b: bytes, scheme: str, iv_size: int, crypt: int, skip: int, constant: bytes | None) -> list[dict]:
    """What each cipher run (a sample, with cbcs a subsample) gives to AES: counter blocks, or its bytes and what pads them."""
    out = []
    chained = scheme in CHAINED
    for _, at, size, own, parts in fragment_samples(b, iv_size):
        iv = (own or constant or b"").ljust(16, b"\0")[:16]
        units: list[list] = [[]]
        for part in parts or [{"clear": 0, "encrypted": size}]:
            units[-1] += _spots(at + part["clear"], part["encrypted"], crypt, skip, chained)
            at += part["clear"] + part["encrypted"]
            if scheme == "cbcs":
                units.append([])
        for unit in filter(None, units):
            mask = b""
            if chained:
                body = b"".join(b[x : x + n] for x, n in unit)
                mask = (np.frombuffer(body[-16:], np.uint8) ^ 16).tobytes()
            else:
                blocks = -(-sum(n for _, n in unit) // 16)
                counters = np.empty((blocks, 2), ">u8")
                counters[:, 0] = int.from_bytes(iv[:8], "big")
                counters[:, 1] = np.arange(blocks, dtype=np.uint64) + np.uint64(int.from_bytes(iv[8:], "big"))
                body = counters.tobytes()
            out.append({"at": [x for x, _ in unit], "n": [n for _, n in unit], "iv": iv, "body": body, "mask": mask})
    return out


@F.pandas_udf(T.ArrayType(_RUN))
def _runs(data: pd.Series, scheme: pd.Series, iv_size: pd.Series, crypt: pd.Series, skip: pd.Series, constant: pd.Series) -> pd.Series:
    rows = zip(data, scheme, iv_size, crypt, skip, constant, strict=True)
    return pd.Series([None if b is None else _cipher_runs(b, s, int(i), int(c), int(k), v) for b, s, i, c, k, v in rows], dtype=object)


@F.pandas_udf(T.BinaryType())
def _in_place(data: pd.Series, runs: pd.Series, texts: pd.Series, chained: pd.Series) -> pd.Series:
    """Bytes with every run in the clear: ``texts`` are its plain bytes, or the key stream over them."""

    def put(b: bytes | None, found, streams, plain: bool) -> bytes | None:
        if b is None or found is None:
            return b
        out = np.frombuffer(b, np.uint8).copy()
        for run, stream in zip(found, streams, strict=True):
            text, used = np.frombuffer(stream, np.uint8), 0
            for at, n in zip(run["at"], run["n"], strict=True):
                piece = text[used : used + n]
                out[at : at + n] = piece if plain else out[at : at + n] ^ piece
                used += n
        return out.tobytes()

    return pd.Series([put(*row) for row in zip(data, runs, texts, chained, strict=True)], dtype=object)


def clear(data: Column, key: Column, scheme: Column, iv_size: Column, crypt: Column, skip: Column, constant_iv: Column) -> Column:
    """A segment in the clear; one without key stays as it is.

    A pattern encrypts ``crypt`` of every ``crypt + skip`` blocks. Counters run on
    over a sample's encrypted bytes. Chaining takes whole blocks only; cbcs starts
    again with its constant IV in every subsample, cbc1 runs on over the sample.
    All of it happens inside the row, so segments are neither copied nor shuffled.
    """
    chained = F.coalesce(scheme.isin(*CHAINED), F.lit(False))
    zero = F.lit(0)
    runs = _runs(F.when(key.isNotNull(), data), F.coalesce(scheme, F.lit("cenc")), F.coalesce(iv_size, zero), F.coalesce(crypt, zero), F.coalesce(skip, zero), constant_iv)
    ecb = lambda block: F.aes_encrypt(block, key, F.lit("ECB"), F.lit("PKCS"))
    chain = lambda r: F.aes_decrypt(F.concat(r["iv"], r["body"], F.substring(ecb(r["mask"]), 1, 16)), key, F.lit("CBC"), F.lit("PKCS"))
    texts = F.transform(runs, lambda r: F.when(chained, chain(r)).otherwise(ecb(r["body"])))
    return _in_place(data, runs, texts, chained)


def decrypted(segments: DataFrame) -> DataFrame:
    """id, data: segments (id, data, key, scheme, iv_size, crypt, skip, constant_iv) in the clear (see ``clear``)."""
    return segments.select("id", clear(*map(F.col, ("data", "key", "scheme", "iv_size", "crypt", "skip", "constant_iv"))).alias("data"))
