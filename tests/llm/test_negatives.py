import numpy as np
import pytest
from pyspark.sql import functions as F

from weirstream.llm import negatives, queries


def brute(rows, k=10, positives=5, low=30, high=90):
    rows = [(i, label, np.array(v, np.int64)) for i, label, v in rows if None not in (i, label, v)]
    width = max(len(v) for *_, v in rows)
    whole = np.array([np.pad(v, (0, width - len(v))) for *_, v in rows])
    out = []
    for a, (own, label, _) in enumerate(rows):
        if own % 100:
            continue
        score = whole @ whole[a]
        order = sorted((-int(score[j]), rows[j][0], j) for j in range(len(rows)) if j != a)
        for s, i, _ in [x for x in order if rows[x[2]][1] == label][:positives]:
            found = [x for x in order if rows[x[2]][1] != label and low * -s <= -100 * x[0] <= high * -s][:k]
            out += [(own, i, rank, x[1], -s, -x[0]) for rank, x in enumerate(found, 1)]
    return sorted(out)


def cases():
    rng = np.random.default_rng(1)
    plain = [(i, int(rng.integers(0, 3)), rng.integers(-300, 300, 8).tolist()) for i in range(500)]
    yield "plain", plain
    yield "a hot vector under many ids", plain + [(i, i % 3, [250] * 8) for i in range(500, 900)]
    odd = [(None, 1, [1, 2]), (3, None, [1, 2]), (4, 1, None), (5, 1, [3]), (6, 1, []), (700, 2, [9, 9, 9])]
    yield "repeated ids and rows", [(int(rng.integers(0, 4) * 100), int(rng.integers(0, 3)), rng.integers(-3, 4, 3).tolist()) for _ in range(200)] + odd
    yield "great numbers", [((1 << 61) * (i % 3 - 1) // 100 * 100 + i * (100 if i % 4 else 1), i % 2, [2**29 - (i % 7) * 2**26, 1, i % 5]) for i in range(80)]


@pytest.mark.parametrize("name, rows", list(cases()), ids=lambda x: x if isinstance(x, str) else "")
def test_mining_matches_brute_force(spark, name, rows):
    """With few bits a pass, so that scores and ids are refined more than once."""
    digit, spare = {"plain": (8, 64), "great numbers": (16, 1)}.get(name, (6, 1))
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, v array<long>, rank string").repartition(3)
    got = sorted(map(tuple, negatives.mine(frame, F.col("vec_id") % 100 == 0, digit=digit, spare=spare).collect()))
    want = brute(rows)
    assert want and got == want


def test_small_blocks(spark, monkeypatch):
    """Many blocks of either kind meet."""
    monkeypatch.setattr(negatives, "ITEM_BLOCK", 17)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 2)
    rng = np.random.default_rng(2)
    rows = [(i * 10, int(rng.integers(0, 2)), rng.integers(-50, 50, 5).tolist()) for i in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, v array<long>")
    assert sorted(map(tuple, negatives.mine(frame, F.col("vec_id") % 100 == 0, k=3, positives=2).collect())) == brute(rows, 3, 2)


def test_nothing_to_mine(spark):
    frame = spark.createDataFrame([(100, 1, [1, 2]), (200, 1, [-1, -2])], "vec_id long, label int, v array<long>")
    assert negatives.mine(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(frame, F.col("vec_id") % 100 == 0).count() == 0  # one label only, and a negative score
    assert negatives.mine(frame, F.lit(False)).count() == 0


def test_bucket_counts_are_a_histogram():
    rng = np.random.default_rng(3)
    for high, low in ((900, -900), (5, 5), ((1 << 63) - 1, -(1 << 63))):
        values = rng.integers(max(low, -(1 << 62)), min(high, 1 << 62) + 1, 400)
        for descending in (True, False):
            buckets = list(negatives.bucket_counts(values, np.ones(400, np.int64), high, low, 10**9, 4, descending))
            assert sum(n for *_, n in buckets) == 400
            for b, a, z, n in buckets:
                assert low <= a <= z <= high and n == sum(a <= x <= z for x in values.tolist())
            ordered = sorted(values.tolist(), reverse=descending)
            pruned = list(negatives.bucket_counts(values, np.ones(400, np.int64), high, low, 7, 4, descending))
            assert pruned == buckets[: len(pruned)] and pruned[-1][1] <= ordered[6] <= pruned[-1][2]


def test_query_matches_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 10)) if i % 17 else None, rng.normal(size=6).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400, 1, None), (500, 1, [None, 1.0]), (600, 2, [float("nan"), 1.0]), (700, 2, [float("inf")])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    whole = [(i, (label + 1) % 10 if label is not None and i % 7 == 0 else label, None if v is None or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, label, v in rows]
    assert sorted(map(tuple, queries.op11_hard_negatives(spark, str(tmp_path)).collect())) == brute(whole)
