"""A block cipher over the video of transport streams, whose IV a service name holds.

A segment is deciphered inside its row. Runs of packets make up a PES packet; from a
video PES the NAL units are cut, whose heads and last bytes are clear. What lies
between is XORed with counters that start anew in every unit: each tenth block and the
last one with the counter under AES, the others with the plain counter. Only those
AES blocks are needed, so one batch UDF names the counters, Spark's AES goes over
them in one call, and a second UDF applies them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .binary import by_row

#: Fixed values of the format.
PACKET, SYNC = 188, 0x47
PAT, SERVICES, PROGRAM = 0x0000, 0x0011, 0x1000
VIDEO, AUDIO = 0x0100, 0x0101
H264, SERVICE_TAG, IV_MARK = 0x1B, 0x48, b"mdcm"
#: Of the IV in a service name this many bytes count; the others are zero.
IV_BYTES = 12
#: One block in so many is under AES.
CADENCE = 10


class Sections:
    """PSI sections of one PID, put together from its packets."""

    def __init__(self):
        self.held: bytes | None = None

    def push(self, packet: bytes) -> bytes | None:
        """The section that a packet makes whole, if any; what follows it in the packet is left."""
        at = payload_start(packet)
        if at >= PACKET:
            return None
        load = packet[at:]
        if packet[1] & 0x40:
            begin = 1 + load[0]
            if begin > len(load):
                return None
            self.held, load = b"", load[begin:]
        if self.held is None:
            return None
        self.held += load
        if len(self.held) < 3 or len(self.held) < (size := 3 + ((self.held[1] & 15) << 8 | self.held[2])):
            return None
        found, self.held = self.held[:size], None
        return found


def payload_start(packet: bytes) -> int:
    """Where a packet's payload begins; its size if it has none."""
    kind = packet[3] >> 4 & 3
    return 4 if kind == 1 else min(5 + packet[4], PACKET) if kind == 3 else PACKET


def service_names(section: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """service id, provider, name of the service descriptors of a service table."""
    if len(section) < 16 or section[0] != 0x42:
        return
    end = min(3 + ((section[1] & 15) << 8 | section[2]), len(section)) - 4
    at = 11
    while at + 5 <= end:
        service, stop = int.from_bytes(section[at : at + 2], "big"), at + 5 + ((section[at + 3] & 15) << 8 | section[at + 4])
        at += 5
        while at + 2 <= min(stop, end):
            tag, body = section[at], section[at + 2 : at + 2 + section[at + 1]]
            if len(body) < section[at + 1]:
                break
            at += 2 + section[at + 1]
            if tag == SERVICE_TAG and len(body) >= 3 and 2 + body[1] < len(body):
                name_at = 3 + body[1]
                if name_at + body[name_at - 1] <= len(body):
                    yield service, body[2 : name_at - 1], body[name_at : name_at + body[name_at - 1]]
        at = stop


def iv_of(name: bytes) -> bytes | None:
    """The IV of a service name ``mdcm|provider|service|?<32 hex digits>``; null if it holds none."""
    parts = name.split(b"|")
    if len(parts) < 4 or parts[0] != IV_MARK or len(parts[3]) != 33:
        return None
    digits = parts[3][1:]
    if not all(d in b"0123456789abcdefABCDEF" for d in digits):
        return None
    return bytes.fromhex(digits.decode())[:IV_BYTES]


def stream_types(section: bytes) -> dict[int, int]:
    """PID to stream type, of a program map; the first entry of a PID counts."""
    end = 3 + ((section[1] & 15) << 8 | section[2]) if len(section) >= 12 and section[0] == 2 else 0
    found: dict[int, int] = {}
    if not end or end > len(section):
        return found
    at = 12 + ((section[10] & 15) << 8 | section[11])
    while at + 5 <= end - 4:
        found.setdefault((section[at + 1] & 31) << 8 | section[at + 2], section[at])
        at += 5 + ((section[at + 3] & 15) << 8 | section[at + 4])
    return found


def runs(b: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bytes, int]]:
    """PES packets: first packet and the one behind, the packets that are theirs, where their payloads begin, the IV, and the bytes of a NAL head (0 of audio).

    A run begins with a PES head on one of the two PIDs once an IV is known, and
    takes in what follows on either until another PES begins or any other packet
    comes; packets that have lost their sync byte don't end it.
    """
    n = len(b) // PACKET
    a = _packets(b)
    sync = a[:, 0] == SYNC
    pid = (a[:, 1].astype(np.int32) & 31) << 8 | a[:, 2]
    kind = a[:, 3] >> 4 & 3
    start = np.where(kind == 1, 4, np.where(kind == 3, 5 + a[:, 4].astype(np.int32), PACKET))
    inside = sync & ((pid == VIDEO) | (pid == AUDIO)) & (start < PACKET)
    head = np.take_along_axis(a, np.minimum(start[:, None] + np.arange(4), PACKET - 1), 1)
    opens = inside & (start + 8 < PACKET) & (head[:, 0] == 0) & (head[:, 1] == 0) & (head[:, 2] == 1) & ((head[:, 3] == 0xC0) | (head[:, 3] == 0xE0))
    borders = np.flatnonzero(opens | (sync & ~inside))
    tables = {SERVICES: Sections(), PROGRAM: Sections()}
    iv, types = None, {}
    for at, until in zip(borders.tolist(), np.append(borders, n)[1:].tolist(), strict=True):
        if opens[at]:
            if iv is not None:
                members = at + np.flatnonzero(inside[at:until])
                unit_head = 0 if head[at, 3] != 0xE0 else 1 if types.get(int(pid[members[-1]]), 0) == H264 else 2
                yield at, until, members, start[members], iv, unit_head
        elif pid[at] in tables and (section := tables[int(pid[at])].push(a[at].tobytes())):
            if pid[at] == PROGRAM:
                types = stream_types(section) if iv is not None else types
            elif found := next((v for *_, name in service_names(section) if (v := iv_of(name)) is not None), None):
                types = types if found == iv else {}
                iv = found


def unit_spans(pes: bytes, head: int) -> Iterator[tuple[int, int]]:
    """The enciphered stretches of a PES packet's NAL units: behind start code and head, up to two bytes before the end (or before a zero and the next start code)."""
    if len(pes) < 9 or (begin := 9 + pes[8]) > len(pes):
        return
    code = pes.find(b"\0\0\1", begin)
    while code >= 0:
        if code > begin:
            first, last = begin + 3 + head, code - 2
            if last > first and (last := last - (pes[code - 1] == 0)) > first:
                yield first, last
            begin = code
        code = pes.find(b"\0\0\1", code + 1)
    if len(pes) - 2 > begin + 3 + head:
        yield begin + 3 + head, len(pes) - 2


def _aes_places(n: int) -> np.ndarray:
    """Which of a unit's ``n`` blocks are under AES."""
    return np.unique(np.append(np.arange(0, n, CADENCE), n - 1))


def _counters(iv: bytes, places: np.ndarray) -> np.ndarray:
    """The counter blocks of places (from 0) in a unit."""
    out = np.empty((len(places), 16), np.uint8)
    out[:, :IV_BYTES] = np.frombuffer(iv, np.uint8)
    out[:, IV_BYTES:] = (places + 1).astype(">u4").view(np.uint8).reshape(-1, 4)
    return out


def _packets(b: bytes) -> np.ndarray:
    n = len(b) // PACKET
    return np.frombuffer(b[: n * PACKET], np.uint8).reshape(n, PACKET)


def _pes(a: np.ndarray, members: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.arange(PACKET) >= start[:, None]
    return a[members][mask], mask


def _stripped(unit: bytes) -> bytes:
    """Without the bytes that keep start codes out."""
    return unit.replace(b"\0\0\3", b"\0\0")


@F.arrow_udf(T.BinaryType())
def aes_counters(data: pa.Array) -> pa.Array:
    """The counter blocks that a segment needs under AES, each once."""

    def wanted(b: bytes) -> bytes:
        a = _packets(b)
        places: dict[bytes, set[int]] = {}
        for _, _, members, start, iv, head in runs(b):
            pes = _pes(a, members, start)[0].tobytes()
            for first, last in unit_spans(pes, head) if head else ():
                places.setdefault(iv, set()).update(_aes_places(-(-len(_stripped(pes[first:last])) // 16)).tolist())
        return b"".join(_counters(iv, np.array(sorted(p))).tobytes() for iv, p in sorted(places.items()))

    return by_row(wanted, data)


@F.arrow_udf(T.BinaryType())
def deciphered(data: pa.Array, counters: pa.Array, under_aes: pa.Array) -> pa.Array:
    """Segments with the units of their video clear. ``under_aes`` holds the counters' AES blocks, in their order."""

    def clear(b: bytes, wanted: bytes, blocks: bytes) -> bytes:
        aes = {wanted[i : i + 16]: blocks[i : i + 16] for i in range(0, len(wanted), 16)}
        out = _packets(b).copy()
        order = np.arange(len(out))
        for at, until, members, start, iv, head in runs(b):
            if until - at > len(members):  # packets without sync byte go on before the run that they are in
                order[at:until] = np.concatenate([np.setdiff1d(order[at:until], members), members])
            if not head:
                continue
            flat, mask = _pes(out, members, start)
            pes = flat.tobytes()
            for first, last in unit_spans(pes, head):
                unit = _stripped(pes[first:last])
                n = -(-len(unit) // 16)
                stream = _counters(iv, np.arange(n))
                places = _aes_places(n)
                stream[places] = np.frombuffer(b"".join(aes[c.tobytes()] for c in stream[places]), np.uint8).reshape(-1, 16)
                flat[first : first + len(unit)] = np.frombuffer(unit, np.uint8) ^ stream.ravel()[: len(unit)]
                # a unit that became shorter keeps its last bytes as they were
            whole = out[members]
            whole[mask] = flat
            out[members] = whole
        return out[order].tobytes()

    return by_row(clear, data, counters, under_aes)


def ts_decrypt(data: Column, key: Column) -> Column:
    """A segment in clear: its whole packets; without an IV in it, as they were. Null data or key gives null."""
    counters = aes_counters(data)
    good = F.when(F.octet_length(key) == 16, key).when(key.isNotNull(), F.raise_error(F.lit("the key of a transport stream has 16 bytes")).cast("binary"))
    return deciphered(data, counters, F.aes_encrypt(counters, good, F.lit("ECB"), F.lit("PKCS")))
