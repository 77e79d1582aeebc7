import random

import numpy as np
import pytest

from weirstream.llm import repeats


def brute(docs, length):
    """By definition: count every string of ``length`` bytes, cover the repeated ones."""
    counts = {}
    bodies = [(t or "").encode() for t in docs]
    for b in bodies:
        for i in range(len(b) - length + 1):
            counts[b[i : i + length]] = counts.get(b[i : i + length], 0) + 1
    out = []
    for b in bodies:
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        out.append(bytes(x for x, c in zip(b, cover, strict=True) if not c))
    return out


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcd é") for _ in range(n))
    passages = [text(rng.randrange(30, 200)) for _ in range(6)]
    docs = ["".join(rng.choice([text(rng.randrange(1, 90)), rng.choice(passages)]) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    return [*docs, None, "", docs[0], "a" * 300, "ab" * 100, "x"]


@pytest.mark.parametrize("hot", [4000, 1])
def test_matches_brute_force(spark, hot):
    plan = repeats.Repeats(length=40, gram=12, hot=hot, shard_bytes=500)
    docs = corpus(hot)
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in repeats.without_repeats(frame, plan).collect()}
    want = brute(docs, 40)
    assert [got[i] for i in range(len(docs))] == want


def test_odd_rows(odd_docs, no_docs):
    plan = repeats.Repeats(length=20, gram=8)
    rows = repeats.without_repeats(odd_docs, plan).collect()
    assert len(rows) == odd_docs.count()
    want = sorted(brute([r.text for r in odd_docs.collect()], 20))
    assert sorted(bytes(r.kept) for r in rows) == want
    assert rows[0].k == 1 and rows[0].shard == "x"
    assert repeats.without_repeats(no_docs).count() == 0


def test_index_statistics():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 60))) for _ in range(12)]
    texts += [texts[0], texts[1][3:]]
    index = repeats.RunLengthIndex(texts)
    got = index.matching()
    suffixes = [(i, j, t[j:]) for i, t in enumerate(texts) for j in range(len(t))]
    for i, j, s in suffixes:
        best = max(next((n for n, (x, y) in enumerate(zip(s, o)) if x != y), min(len(s), len(o))) for a, b, o in suffixes if (a, b) != (i, j))
        assert got[index.starts[i] + j] == best
    assert int(index.lengths.sum()) == len(index.text) and (np.diff(index.sa_head) != 0).all()


def test_windows_cover_every_start_once():
    plan = repeats.Repeats(length=40, gram=12)
    rolls = tuple(repeats.Roller(t) for t in repeats._tables(1))
    data = np.frombuffer(random.Random(3).randbytes(1000), np.uint8)
    _, _, s, n = repeats.windows_of(data, plan, rolls)
    assert sorted(x for a, b in zip(s, n, strict=True) for x in range(a, a + b + 1)) == list(range(1000 - 40 + 1))


def test_rows_without_id_keep_their_own_spans(spark):
    """Texts of rows without id that share a 32-bit hash, and id 0 beside none, are told apart."""
    from pyspark.sql import functions as F

    texts = spark.range(300_000).select(F.concat(F.lit("seed "), F.sha2(F.col("id").cast("string"), 256)).alias("t"))
    pair = texts.groupBy(F.hash("t")).agg(F.collect_list("t").alias("ts"), F.count("*").alias("n")).filter("n > 1").first().ts[:2]
    shared = "the passage that is in both of them " * 3
    rows = [(None, pair[0] + shared), (None, pair[1] + shared[::-1]), (0, shared), (None, shared), (5, shared[::-1])]
    rows = [(i, t) for i, t in rows] + [(None, pair[0]), (None, pair[1]), (0, pair[1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(bytes(r.kept) for r in repeats.without_repeats(frame, repeats.Repeats(length=40, gram=12)).collect())
    assert got == sorted(brute([t for _, t in rows], 40))


def test_query_matches_brute_force(spark, tmp_path):
    import hashlib

    from weirstream.llm.queries import op6_suffix

    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh é ") for _ in range(400))
    docs = ["".join(rng.choice("abcdefgh é ") for _ in range(rng.randrange(0, 500))) + (passage[rng.randrange(100) :] if i % 3 == 0 else "") for i in range(30)] + [None, "", passage]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in op6_suffix(spark, str(tmp_path)).collect()}
    for i, (text, kept) in enumerate(zip(docs, brute(docs, 200), strict=True)):
        n = len((text or "").encode())
        assert got[i] == (n, n - len(kept), hashlib.sha256(kept).hexdigest())
