"""The packet cipher against a plain model that goes packet by packet, with an AES of its own."""

import random

import pytest
from pyspark.sql import functions as F

from weirstream.functions import tscipher
from weirstream.sources import transport
from weirstream.streaming import sink

KEY = bytes(range(16))
IV = bytes.fromhex("F8F9FAFBFCFDFEFFF8F9FAFB")


def _sbox():
    box, p, q = [0] * 256, 1, 1
    while True:
        p = p ^ (p << 1) & 255 ^ (27 if p & 128 else 0)
        for s in (1, 2, 4):
            q = q ^ q << s & 255
        q ^= 9 if q & 128 else 0
        box[p] = q ^ (q << 1 | q >> 7) & 255 ^ (q << 2 | q >> 6) & 255 ^ (q << 3 | q >> 5) & 255 ^ (q << 4 | q >> 4) & 255 ^ 0x63
        if p == 1:
            box[0] = 0x63
            return box


SBOX = _sbox()


def aes(key, block):
    words, rcon = [list(key[i : i + 4]) for i in range(0, 16, 4)], 1
    for i in range(4, 44):
        t = words[-1]
        if i % 4 == 0:
            t = [SBOX[x] for x in t[1:] + t[:1]]
            t[0] ^= rcon
            rcon = rcon << 1 ^ (0x11B if rcon & 128 else 0)
        words.append([a ^ b for a, b in zip(words[-4], t, strict=True)])
    keys = [sum(words[4 * r : 4 * r + 4], []) for r in range(11)]
    twice = lambda x: (x << 1) & 255 ^ (27 if x & 128 else 0)
    s = [a ^ b for a, b in zip(block, keys[0], strict=True)]
    for r in range(1, 11):
        s = [SBOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
        if r < 10:
            s = [twice(s[c + i]) ^ twice(s[c + (i + 1) % 4]) ^ s[c + (i + 1) % 4] ^ s[c + (i + 2) % 4] ^ s[c + (i + 3) % 4] for c in (0, 4, 8, 12) for i in range(4)]
        s = [a ^ b for a, b in zip(s, keys[r], strict=True)]
    return bytes(s)


def test_model_aes():
    assert aes(bytes.fromhex("000102030405060708090a0b0c0d0e0f"), bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"


def unit_model(unit, iv):
    kept, i = bytearray(), 0
    while i < len(unit):
        if unit[i : i + 3] == b"\0\0\3":
            kept += b"\0\0"
            i += 3
        else:
            kept.append(unit[i])
            i += 1
    out, block = bytearray(), 0
    while len(out) < len(kept):
        counter = (int.from_bytes(iv.ljust(16, b"\0"), "big") + block + 1).to_bytes(16, "big")
        rest = len(kept) - len(out)
        stream = aes(KEY, counter) if block % 10 == 0 or rest <= 16 else counter
        out += bytes(a ^ b for a, b in zip(kept[len(out) : len(out) + 16], stream, strict=False))
        block += 1
    return bytes(out) + unit[len(out) :]


def pes_model(pes, iv, head):
    begin = 9 + pes[8]
    out = bytearray(pes)
    if begin > len(pes):
        return pes
    codes = [i for i in range(begin + 1, len(pes) - 2) if pes[i : i + 3] == b"\0\0\1"]
    for a, z in zip([begin, *codes], [*codes, None], strict=True):
        first = a + 3 + head
        last = len(pes) - 2 if z is None else z - 2
        if last > first:
            if z is not None and pes[z - 1] == 0:
                last -= 1
            out[first:last] = unit_model(pes[first:last], iv) if last > first else b""
    return bytes(out)


def model(b):
    """Packet after packet, with a queue of those of the open PES."""
    out, queue, pes, iv, types, last = [], [], b"", None, {}, None

    def close():
        nonlocal queue, pes
        if queue and pes[3] == 0xE0:
            pes = pes_model(pes, iv_at, 1 if types.get(last) == 0x1B else 2)
        at = 0
        for head in queue:
            out.append(head + pes[at : at + 188 - len(head)])
            at += 188 - len(head)
        queue, pes = [], b""

    for i in range(0, len(b) // 188 * 188, 188):
        p = b[i : i + 188]
        if p[0] != 0x47:
            out.append(p)
            continue
        pid, kind = (p[1] & 31) << 8 | p[2], p[3] >> 4 & 3
        start = 4 if kind == 1 else 5 + p[4] if kind == 3 else 188
        if pid in (0, 0x11, 0x1000) or iv is None or pid not in (0x100, 0x101) or start >= 188:
            close()
            out.append(p)
            if pid == 0x11 and p[5:6] == b"\x42":
                found = bytes.fromhex(p.split(b"|?")[1][:32].decode())[:12]
                types, iv = (types if found == iv else {}), found
            if pid == 0x1000 and iv is not None:
                types = {0x100: p[4 + 1 + 12]}
            continue
        new = start + 8 < 188 and p[start : start + 3] == b"\0\0\1" and p[start + 3] in (0xC0, 0xE0)
        if new:
            close()
            iv_at = iv
        elif not queue:
            out.append(p)
            continue
        queue.append(p[:start])
        pes += p[start:]
        last = pid
    close()
    return b"".join(out)


def packet(pid, load, kind=1, unit=False):
    """One packet; short payloads are filled by an adaptation field."""
    head = bytes([0x47, (0x40 if unit else 0) | pid >> 8, pid & 255])
    if len(load) == 184 and kind == 1:
        return head + b"\x10" + load
    if kind == 2:
        return head + b"\x20" + bytes([183, 0]) + b"\xff" * 182
    size = 183 - len(load)
    return head + b"\x30" + bytes([size]) + (b"\0" + b"\xff" * (size - 1) if size else b"") + load


def table(pid, section):
    return packet(pid, (b"\0" + section).ljust(184, b"\xff"), unit=True)


def service_table(iv, name=b"mdcm|p|s|?"):
    name += iv.ljust(16, b"\0").hex().encode()
    body = bytes([1, 2]) + b"pr" + bytes([len(name)]) + name
    loop = bytes([0x48, len(body)]) + body
    rest = b"\0\1\xc1\0\0\0\1\xff" + b"\0\5\xfc" + len(loop).to_bytes(2, "big") + loop + b"crc!"
    return table(0x11, b"\x42" + (0xF000 | len(rest)).to_bytes(2, "big") + rest)


def program_map(kind):
    rest = b"\0\1\xc1\0\0\xe1\0\xf0\0" + bytes([kind]) + b"\xe1\0\xf0\0" + b"crc!"
    return table(0x1000, b"\2" + (0xB000 | len(rest)).to_bytes(2, "big") + rest)


def segment(rng):
    out = []
    for _ in range(rng.randrange(1, 9)):
        what = rng.random()
        if what < 0.25:
            out.append(service_table(rng.choice([IV, bytes(12), bytes(rng.randrange(256) for _ in range(12))])))
        elif what < 0.4:
            out.append(program_map(rng.choice([0x1B, 0x24])))
        elif what < 0.5:
            out.append(packet(rng.choice([0, 0x100, 0x200, 0x1FFF]), b"x" * 184, rng.choice([1, 2])))
        else:
            load = bytearray(rng.randrange(256) if rng.random() < 0.7 else rng.choice([0, 0, 1, 3]) for _ in range(rng.choice([5, 40, 400, 3000])))
            pes = b"\0\0\1" + rng.choice([b"\xe0", b"\xe0", b"\xc0", b"\xbd"]) + b"\0\0\x80\0" + bytes([rng.choice([0, 5, 250])]) + rng.choice([b"\0\0\1\x65", b""]) + bytes(load)
            pid, at = rng.choice([0x100, 0x100, 0x101]), 0
            while at < len(pes):
                size = rng.choice([184, 184, 183, 100, 20])
                out.append(packet(pid, pes[at : at + size]))
                at += size
                if rng.random() < 0.05:
                    out.append(rng.choice([b"\0" * 188, packet(0x200, b"y" * 184), packet(0x101, b"z" * 184), packet(0x100, b"", 2)]))
    return b"".join(out) + b"\x47" * rng.randrange(3)


def test_cipher_matches_the_model(spark):
    rng = random.Random(1)
    segments = [segment(rng) for _ in range(150)] + [b"", b"short", None, b"\x47" * 188]
    segments.append(service_table(IV) + program_map(0x1B) + b"".join(packet(0x100, (b"\0\0\1\xe0\0\0\x80\0\0\0\0\1\x65" if i == 0 else b"") + bytes(184 - 13 * (i == 0))) for i in range(60)))
    rows = spark.createDataFrame(list(enumerate(segments)), "i int, data binary").withColumn("clear", tscipher.ts_decrypt(F.col("data"), F.lit(KEY))).collect()
    changed = 0
    for r in rows:
        b = segments[r.i]
        want = None if b is None else model(b)
        assert (None if r.clear is None else bytes(r.clear)) == want, r.i
        changed += b is not None and want != b
    assert changed > 60


def test_key_sizes(spark):
    frame = spark.createDataFrame([(b"\x47" * 188,)], "data binary")
    assert frame.select(tscipher.ts_decrypt(F.col("data"), F.lit(None).cast("binary")).alias("x")).first().x is None
    with pytest.raises(Exception, match="16 bytes"):
        frame.select(tscipher.ts_decrypt(F.col("data"), F.lit(b"short"))).collect()


def test_services(spark):
    b = service_table(IV) + service_table(IV, b"other|") + service_table(IV, b"mdcm|a|b|")
    rows = transport.services(spark.createDataFrame([("s", 1, b), ("s", 2, None), ("s", 3, b"")], "stream string, segment long, data binary")).collect()
    assert [(r.segment, r.service, r.provider, r.iv and bytes(r.iv)) for r in rows] == [(1, 5, "pr", IV + bytes(4)), (1, 5, "pr", None), (1, 5, "pr", None)]


def test_chain_ends_with_the_packet_cipher(spark):
    b = service_table(IV) + program_map(0x1B) + packet(0x100, b"\0\0\1\xe0\0\0\x80\0\0" + b"\0\0\1\x65" + b"v" * 171)
    pieces = [("a", False, b"\x89PNG" + b"-" * 50 + b, KEY), ("a", True, b, KEY), ("b", False, b, None)]
    frame = spark.createDataFrame([(s, i, d, None, None, 0, k) for s, i, d, k in pieces], "stream_id string, is_init boolean, data binary, aes_key binary, iv binary, seq long, ts_key binary")
    got = [bytes(r.data) for r in sink.transformed(frame).orderBy("stream_id", "is_init").collect()]
    assert got == [model(b), b, b] and model(b) != b


def test_sealed_texts_hold_no_start_codes(spark):
    from weirstream import live_queries

    loads = [bytes(7), b"\0\0\1a", b"a\0\0\3\0\0\2", b"\1\0\0", b"\x10\0\0\x10", b"\x30\0\0\0\x01"]
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(loads)], "i int, b binary").withColumn("e", F.unhex(live_queries._without_start_codes(F.hex("b"))))
    for r in rows.collect():
        assert not any(bytes((0, 0, n)) in bytes(r.e) for n in (0, 1, 2)) and tscipher._stripped(bytes(r.e)) == loads[r.i]


def test_each_row_comes_back_without_a_shuffle(spark, tmp_path):
    """Ids that are null or repeated, and texts from none to many packets; what is sealed meets no other row."""
    import hashlib

    from weirstream import live_queries

    rows = [(None, "no id"), (None, None), (7, "twice"), (7, "twice"), (7, "another")] + [(100 + n, "é" * n) for n in (*range(0, 200, 7), 5000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = live_queries.ts_cipher(spark, str(tmp_path))
    got = sorted(map(tuple, out.collect()), key=str)
    plain = [(i, b"." + (text or "").encode()) for i, text in rows]
    assert got == sorted(((i, len(b), hashlib.md5(b).hexdigest()) for i, b in plain), key=str)  # noqa: S324
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
