import random
import struct

import pytest
from pyspark.sql import functions as F

from weirstream.functions import cenc

KEY = bytes(range(16))


def box(kind, payload=b""):
    return struct.pack(">I", 8 + len(payload)) + kind + payload


def fragment(samples, ivs, parts, aux=False):
    """moof + mdat of samples with sizes in trun; IVs in senc, or behind the moof's tables."""
    entries = [iv + (struct.pack(">H", len(p)) + b"".join(struct.pack(">HI", c, n) for c, n in p) if p else b"") for iv, p in zip(ivs, parts)]
    sizes = b"".join(struct.pack(">I", len(s)) for s in samples)

    def build(offset, place):
        trun = box(b"trun", struct.pack(">II", 0x201, len(samples)) + struct.pack(">i", offset) + sizes)
        if aux:
            tables = box(b"saiz", bytes(4) + b"\0" + struct.pack(">I", len(entries)) + bytes(map(len, entries))) + box(b"saio", struct.pack(">III", 0, 1, place)) + box(b"free", b"".join(entries))
        else:
            tables = box(b"senc", struct.pack(">II", 2 if any(parts) else 0, len(entries)) + b"".join(entries))
        return box(b"moof", box(b"traf", box(b"tfhd", bytes(8)) + trun + tables))

    size = len(build(0, 0))
    moof = build(size + 8, size - sum(map(len, entries)))
    return moof + box(b"mdat", b"".join(samples))


def blocks(spark, values):
    rows = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)], "i int, b binary")
    out = rows.select("i", F.substring(F.aes_encrypt("b", F.lit(bytearray(KEY)), F.lit("ECB"), F.lit("PKCS")), 1, 16).alias("c")).orderBy("i").collect()
    return [bytes(r.c) for r in out]


def ctr(spark, data, iv):
    start = int.from_bytes(iv.ljust(16, b"\0")[8:], "big")
    stream = b"".join(blocks(spark, [iv[:8].ljust(8, b"\0") + struct.pack(">Q", start + i) for i in range(-(-len(data) // 16))]))
    return bytes(a ^ b for a, b in zip(data, stream))


def cbc(spark, data, iv):
    out, last = [], iv
    for i in range(0, len(data), 16):
        last = blocks(spark, [bytes(a ^ b for a, b in zip(data[i : i + 16], last))])[0]
        out.append(last)
    return b"".join(out)


def run(spark, data, scheme, iv_size=8, crypt=0, skip=0, constant=None, key=KEY):
    schema = "id long, data binary, key binary, scheme string, iv_size int, crypt int, skip int, constant_iv binary"
    row = (1, bytearray(data), key and bytearray(key), scheme, iv_size, crypt, skip, constant and bytearray(constant))
    return bytes(cenc.decrypted(spark.createDataFrame([row], schema)).first().data)


def test_counters_with_subsamples(spark):
    rng = random.Random(1)
    plain = [rng.randbytes(n) for n in (96, 64, 160)]
    parts = [[], [(10, 20), (5, 29)], [(16, 100), (0, 44)]]
    parts[0] = [(0, 96)]
    ivs = [struct.pack(">Q", i + 7) for i in range(3)]
    sealed = []
    for p, sub, iv in zip(plain, parts, ivs):
        at, spots = 0, []
        for c, n in sub:
            spots += range(at + c, at + c + n)
            at += c + n
        hidden = ctr(spark, bytes(p[i] for i in spots), iv)
        out = bytearray(p)
        for i, x in zip(spots, hidden):
            out[i] = x
        sealed.append(bytes(out))
    want = fragment(plain, ivs, parts)
    assert run(spark, fragment(sealed, ivs, parts), "cenc") == want
    assert run(spark, fragment(sealed, ivs, parts, aux=True), "cenc") == fragment(plain, ivs, parts, aux=True)
    assert run(spark, fragment(sealed, ivs, parts), "cenc", key=None) == fragment(sealed, ivs, parts)


def test_pattern_with_constant_iv(spark):
    rng = random.Random(2)
    plain = [rng.randbytes(400), rng.randbytes(90)]
    parts = [[(32, 360), (8, 0)], [(10, 40), (8, 32)]]
    iv = b"\x11" * 16
    sealed = []
    for p, sub in zip(plain, parts):
        out, at = bytearray(p), 0
        for c, n in sub:
            spots = [at + c + o for o in range(0, n, 160) if o + 16 <= n]
            hidden = cbc(spark, b"".join(p[i : i + 16] for i in spots), iv)
            for j, i in enumerate(spots):
                out[i : i + 16] = hidden[16 * j : 16 * j + 16]
            at += c + n
        sealed.append(bytes(out))
    assert run(spark, fragment(sealed, [b"", b""], parts), "cbcs", 0, 1, 9, iv) == fragment(plain, [b"", b""], parts)


def test_whole_sample_chaining(spark):
    rng = random.Random(3)
    plain, iv = rng.randbytes(70), rng.randbytes(16)
    sealed = cbc(spark, plain[:64], iv) + plain[64:]
    assert run(spark, fragment([sealed], [iv], [[]]), "cbc1", 16) == fragment([plain], [iv], [[]])


def based(samples, ivs, base, offset, flags=1):
    """A fragment whose tfhd has a base data offset."""
    sizes = b"".join(struct.pack(">I", len(s)) for s in samples)
    tfhd = box(b"tfhd", struct.pack(">IIQ", flags, 1, base))
    trun = box(b"trun", struct.pack(">IIi", 0x201, len(samples), offset) + sizes)
    senc = box(b"senc", struct.pack(">II", 0, len(ivs)) + b"".join(ivs))
    return box(b"moof", box(b"traf", tfhd + trun + senc)) + box(b"mdat", b"\xee" * 24 + b"".join(samples))


def test_explicit_base_data_offset(spark):
    rng = random.Random(4)
    plain, ivs = [rng.randbytes(48), rng.randbytes(33)], [struct.pack(">Q", i + 3) for i in range(2)]
    sealed = [ctr(spark, p, iv) for p, iv in zip(plain, ivs)]
    first = fragment([plain[0]], [ivs[0]], [[]])
    head = len(based(plain, ivs, 0, 0)) - 24 - 81  # up to the mdat's bytes
    for before in (b"", first):
        at = len(before) + head + 24
        want = (fragment([ctr(spark, plain[0], ivs[0])], [ivs[0]], [[]]) if before else b"") + based(plain, ivs, at - 10, 10)
        assert run(spark, before + based(sealed, ivs, at - 10, 10), "cenc") == want
        # default-base-is-moof goes before it
        moof = based(sealed, ivs, 5, head + 24, 0x20001)
        assert run(spark, before + moof, "cenc")[-81:] == b"".join(plain)
    with pytest.raises(ValueError, match="outside mdat"):
        cenc.fragment_samples(based(sealed, ivs, 10_000, 0), 8)
