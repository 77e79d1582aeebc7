"""Exact top-k inner product search over norm-sorted blocks (operator 1).

Vectors are rotated by the eigenvectors of their Gram matrix (the SVD rotation),
so that the first coordinates hold most of the length, and lie in blocks of
descending length. A block can't matter to a query whose k-th best score so far
is above |query| * |longest vector|. Within a block the first coordinates'
partial sums, with Cauchy-Schwarz on what is left of either vector, bound every
score; only pairs whose bound reaches the query's k-th best are scored exactly,
in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_salts, staged

ITEM_BLOCK, QUERY_BLOCK, SEEDS = 4096, 2048, 4096
#: Most bytes of a block of items, and of a block of queries in all slots together: Spark holds the copies of a row that is exploded at once.
BLOCK_BYTES, SPREAD_BYTES = 1 << 23, 1 << 26
#: What float rounding may take from a bound, as a share of |query| * |vector|.
SLACK = 1e-9


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null if the vector is null or holds null, NaN or infinity."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(doubles, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.when(finite, F.transform(doubles, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def _matrix(vectors, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _packed(matrix: np.ndarray) -> bytes:
    """A matrix of whole numbers in the least bytes that hold each of them, whose number stands in front."""
    low, high = matrix.min(initial=0), matrix.max(initial=0)
    size = next(n for n in (1, 2, 4, 8) if np.iinfo(f"i{n}").min <= low and high <= np.iinfo(f"i{n}").max)
    return bytes([size]) + matrix.astype(f"<i{size}").tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64).reshape(-1, width)


def n_slots(n: int, n_queries: int, parts: int, cores: int) -> int:
    """Into how many slots ``n`` items are dealt, each of which all queries meet.

    More slots than that many parts of a shuffle help nothing, and the queries' copies are to stay below half of
    the items, if that leaves two slots a core. Above, a slot has 64 blocks of items at most.
    """
    return max(1, min(parts, max(2 * cores, n // (2 * max(1, n_queries)))), -(-n // (64 * ITEM_BLOCK)))


def _rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors of the Gram matrix, greatest first. Each task sums its rows' products; width**2 sums reach the driver."""

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for frame in frames:
            m = _matrix(frame["v"], width).astype(np.float64)
            total += m.T @ m
        yield pd.DataFrame({"at": np.arange(width * width), "x": total.ravel()})

    sums = vectors.select("v").mapInPandas(products, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    gram = np.zeros(width * width)
    for r in sums:
        gram[r["at"]] = r["x"]
    _, axes = np.linalg.eigh(gram.reshape(width, width))
    return np.ascontiguousarray(axes[:, ::-1])


def _blocks(vectors: DataFrame, width: int, size: int) -> DataFrame:
    """Rows of up to ``size`` vectors in order of descending length: top (the greatest length), uids, ids, copies, data, least."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def out(frame: pd.DataFrame) -> pd.DataFrame:
            longs = {name: [frame[c].to_numpy(np.int64).tobytes()] for name, c in (("uids", "uid"), ("ids", "id"), ("copies", "copies"), ("least", "least"))}
            return pd.DataFrame({"top": [float(frame["norm"].max())], "data": [_packed(_matrix(frame["v"], width))]} | longs)

        for frame in frames:
            held.append(frame)
            while sum(map(len, held)) >= size:
                whole = pd.concat(held)
                yield out(whole.iloc[:size])
                held = [whole.iloc[size:]]
        whole = pd.concat(held) if held else []
        if len(whole):
            yield out(whole)

    order = [F.col("norm").desc(), F.col("uid")]
    dealt = vectors.select("uid", "id", "copies", "v", "norm", "least").repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInPandas(pack, "top double, data binary, uids binary, ids binary, copies binary, least binary")


def _longs(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.int64)


def best_pairs(own, q, uid, vid, v, least, k: int, axes: np.ndarray, step: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best vectors of a block for each query, if they score ``least`` (one for each query) or more; ties to the smaller id.

    A query does not meet the vector whose ``uid`` is its ``own``. Returns places
    of queries, places of vectors, scores.
    """
    width = axes.shape[1]
    head = max(1, width // 4)
    qf, vf = q.astype(np.float64), v.astype(np.float64)
    qr, vr = qf @ axes, vf @ axes
    q_norm, v_norm = np.sqrt((qf * qf).sum(1)), np.sqrt((vf * vf).sum(1))
    q_rest, v_rest = np.sqrt((qr[:, head:] ** 2).sum(1)), np.sqrt((vr[:, head:] ** 2).sum(1))
    small = q_norm.max(initial=0) * v_norm.max(initial=0) < 2**52  # then sums of whole numbers are exact in floats
    found = []
    for a in range(0, len(q), step):
        rows = slice(a, a + step)
        at = np.nextafter(least[rows].astype(np.float64), -np.inf)  # a float is never above the whole number
        kept: list[np.ndarray] = []
        for b in range(0, len(v), 1024):
            cols = slice(b, b + 1024)
            reach = q_norm[rows, None] * v_norm[None, cols]
            bound = qr[rows, :head] @ vr[cols, :head].T + q_rest[rows, None] * v_rest[None, cols] + SLACK * reach + 1e-6
            qi, vi = np.nonzero((bound >= at[:, None]) & (own[rows, None] != uid[None, cols]))
            if not len(qi):
                continue
            if small and len(qi) > 0.1 * bound.size:
                score = (qf[rows] @ vf[cols].T)[qi, vi].astype(np.int64)
            else:
                score = np.concatenate([np.einsum("ij,ij->i", q[a + qi[i : i + 50_000]], v[b + vi[i : i + 50_000]]) for i in range(0, len(qi), 50_000)])
            ok = score >= at[qi]
            new = np.stack([qi[ok], b + vi[ok], score[ok]])
            both = np.concatenate([*kept, new], axis=1) if kept else new
            both = both[:, np.lexsort((vid[both[1]], -both[2], both[0]))]
            place = np.arange(both.shape[1]) - np.searchsorted(both[0], both[0])
            both = both[:, place < k]
            full = (np.arange(both.shape[1]) - np.searchsorted(both[0], both[0])) == k - 1
            at[both[0, full]] = np.maximum(at[both[0, full]], both[2, full])
            kept = [both]
        if kept:
            found.append(np.stack([kept[0][0] + a, kept[0][1], kept[0][2]]))
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(found, axis=1))


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each query, those with several copies counted as often; ``rank`` from 1."""
    order = Window.partitionBy("uid").orderBy(F.col("score").desc(), "vec_id")
    each = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("times"), F.lit(k)).cast("int")))).drop("copy", "times")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(items: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "v") -> DataFrame:
    """The ``k`` items with the greatest inner product for every row that is a query: query_id, rank (from 1), vec_id, score.

    ``vector`` holds whole numbers (see ``quantised``); rows whose vector or id is
    null take no part. A row is never its own answer, but another row with the
    same id is a candidate like any other, and each of them that is a query has
    its own answers. Ties go to the smaller id. Shorter vectors count as filled
    with zeros. Scores must fit a long. No rows give no rows.

    Items are taken in bands of descending length. Each query carries its k-th
    best score from band to band and leaves when no vector of a band is long
    enough to reach it. Within a band query blocks and item blocks meet in
    slots (see ``n_slots``). What the driver holds is bounded:
    the Gram matrix and the ``SEEDS`` longest vectors, whose scores are the
    first bounds.
    """
    spark = items.sparkSession
    rows = items.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), is_query.alias("q")).filter("id IS NOT NULL AND v IS NOT NULL")
    # rows that repeat id and vector are one row with a number of copies
    rows = rows.groupBy("id", "v").agg(F.max("q").alias("q"), F.count(F.lit(1)).alias("copies"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = staged(rows.withColumn("norm", norm).withColumn("uid", F.monotonically_increasing_id()).withColumn("least", F.lit(-(1 << 63))), "vectors")
    n, n_queries, width, longest, edges = rows.agg(F.count(F.lit(1)), F.count_if("q"), F.max(F.size("v")), F.max("norm"), F.percentile_approx("norm", [1 - 1 / 16, 3 / 4])).first()
    width = max(1, width or 1)
    axes = _rotation(rows, width)
    seeds = rows.orderBy(F.col("norm").desc(), "uid").limit(SEEDS).select("uid", "id", "v").collect()
    seed_uids, seed_ids, seed_vectors = np.array([r["uid"] for r in seeds], np.int64), np.array([r["id"] for r in seeds], np.int64), _matrix([r["v"] for r in seeds], width)
    slots = n_slots(n, n_queries, n_salts(spark), spark.sparkContext.defaultParallelism)
    item_block, query_block = (max(1, min(most, size // (8 * width))) for most, size in ((ITEM_BLOCK, BLOCK_BYTES), (QUERY_BLOCK, SPREAD_BYTES // slots)))

    def first_bounds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = np.where(frame["copies"] > 1, -1, frame["uid"]).astype(np.int64)
            least = frame["least"].to_numpy(np.int64).copy()
            qi, _, score = best_pairs(own, _matrix(frame["v"], width), seed_uids, seed_ids, seed_vectors, least, k, axes)
            full = (np.arange(len(qi)) - np.searchsorted(qi, qi)) == k - 1
            least[qi[full]] = score[full]
            yield frame.assign(least=least)

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                quid, q, uid, vid, copies = _longs(r.uids), _unpacked(r.data, width), _longs(r.item_uids), _longs(r.item_ids), _longs(r.item_copies)
                own = np.where(_longs(r.copies) > 1, -1, quid)
                qi, vi, score = best_pairs(own, q, uid, vid, _unpacked(r.item_data, width), _longs(r.least), k, axes)
                yield pd.DataFrame({"uid": quid[qi], "vec_id": vid[vi], "score": score, "times": copies[vi] - (quid[qi] == uid[vi])})

    queries = rows.filter("q").select("uid", "id", "copies", "v", "norm", "least")
    queries = staged(queries.mapInPandas(first_bounds, queries.schema), "queries")
    best = None  # uid, vec_id, score, rank of what was found so far
    tops = [longest, *edges] if n else []
    for top, bottom in zip(tops, [*tops[1:], -1.0][: len(tops)], strict=True):
        open_queries = queries
        if best is not None:
            bounds = best.groupBy("uid").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("found")).filter(F.col("found") == k)
            open_queries = queries.join(bounds, "uid", "left").withColumn("least", F.greatest("least", F.coalesce("kth", "least")))
        open_queries = open_queries.filter(F.col("norm") * F.lit(top) * (1 + SLACK) + 1 >= F.col("least"))
        asked = _blocks(open_queries, width, query_block).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        band = rows.filter((F.col("norm") <= F.lit(top)) & (F.col("norm") > F.lit(bottom)))
        blocks = _blocks(band, width, item_block).drop("least").select(F.pmod(F.xxhash64("uids"), F.lit(slots)).cast("int").alias("slot"), *[F.col(c).alias(f"item_{c}") for c in ("uids", "ids", "copies", "data")])
        pairs = asked.join(blocks, "slot").select("uids", "copies", "data", "least", "item_uids", "item_ids", "item_copies", "item_data")
        found = pairs.mapInPandas(meet, "uid long, vec_id long, score long, times long")
        if best is not None:
            found = found.union(best.select("uid", "vec_id", "score", F.lit(1).cast("long").alias("times")))
        best = staged(_ranked(found, k), "best")
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    answers = best.join(queries.select("uid", F.col("id").alias("query_id"), "copies"), "uid")
    each = answers.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(F.col("query_id").cast("long").alias("query_id"), "rank", F.col("vec_id").cast("long").alias("vec_id"), "score")
