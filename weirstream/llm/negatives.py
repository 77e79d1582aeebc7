"""Hard negatives by distributed radix selection (operator 11).

An anchor's positives are its first rows of the same label; each of them opens a
window of scores, in which the first rows of other labels are the negatives. The
k-th row of a window isn't sorted for but located: tasks count scores by digit, in
integer histograms per window, the histograms are summed, and the bucket in which
the k-th row lies is refined by its next digit. Where a single score is left and
still too many rows have it, their ids are refined in the same way. Only rows up to
that place are gathered.

Anchors are a stated set of queries: blocks of them meet blocks of all rows, and a
task sees one block of each at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_salts, staged
from .topk import _matrix as matrix

ITEM_BLOCK, ANCHOR_BLOCK = 4096, 512
LEAST, MOST = -(1 << 63), (1 << 63) - 1

#: A window: ``top`` and ``bottom`` are its scores; the k-th row is sought among ``high`` to ``low``, which are
#: scores (by_id false) or ids of rows that score ``least``; ``need`` rows of that range are wanted. Once ``done``,
#: rows that score above ``least`` qualify, and of those that score it the ids up to ``cut``.
_WINDOW = "wid long, anchor long, top long, bottom long, by_id boolean, high long, low long, need long, least long, cut long, done boolean"


@dataclass(frozen=True)
class Selection:
    """``k`` rows a window; ``digit`` bits a pass; a window with at most ``spare`` rows up to its k-th bucket's end is not refined further."""

    k: int
    same_label: bool
    digit: int = 8
    spare: int = 64


def _item_blocks(rows: DataFrame, slots: int) -> DataFrame:
    """All rows in blocks of up to ``ITEM_BLOCK``: slot, and the block's columns packed."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), ITEM_BLOCK):
                part = frame.iloc[at : at + ITEM_BLOCK]
                width = max(map(len, part["v"]), default=0)
                yield pd.DataFrame({"uids": [_packed(part["uid"])], "ids": [_packed(part["id"])], "labels": [_packed(part["label"])], "copies": [_packed(part["copies"])], "width": [width], "data": [matrix(part["v"], width).tobytes()]})

    blocks = rows.select("uid", "id", "label", "copies", "v").mapInPandas(pack, "uids binary, ids binary, labels binary, copies binary, width int, data binary")
    return blocks.withColumn("slot", F.pmod(F.xxhash64("uids"), F.lit(slots)).cast("int"))


def _anchor_blocks(anchors: DataFrame, windows: DataFrame, slots: int) -> DataFrame:
    """The anchors that have a window, in blocks, for every slot; a block's windows go with it."""
    asked = windows.groupBy("anchor").agg(F.collect_list(F.struct(*windows.columns)).alias("windows"))
    rows = anchors.select(F.col("uid").alias("anchor"), F.col("label").alias("own"), "v").join(asked, "anchor")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), ANCHOR_BLOCK):
                part = frame.iloc[at : at + ANCHOR_BLOCK]
                width = max(map(len, part["v"]), default=0)
                place = np.repeat(np.arange(len(part)), [len(w) for w in part["windows"]])
                flat = pd.DataFrame.from_records([w if isinstance(w, dict) else w.asDict() for ws in part["windows"] for w in ws])
                columns = {c: [_packed(flat[c])] for c in ("wid", "top", "bottom", "by_id", "high", "low", "need", "least", "cut")}
                yield pd.DataFrame({"anchors": [_packed(part["anchor"])], "owns": [_packed(part["own"])], "awidth": [width], "adata": [matrix(part["v"], width).tobytes()], "place": [_packed(place)]} | columns)

    schema = "anchors binary, owns binary, awidth int, adata binary, place binary, wid binary, top binary, bottom binary, by_id binary, high binary, low binary, need binary, least binary, cut binary"
    return rows.mapInPandas(pack, schema).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))


def _packed(values) -> bytes:
    return np.asarray(values).astype(np.int64).tobytes()


def _longs(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.int64)


def scores_of(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; shorter vectors count as filled with zeros."""
    width = min(a.shape[1], v.shape[1])
    a, v = a[:, :width], v[:, :width]
    af, vf = a.astype(np.float64), v.astype(np.float64)
    reach = np.sqrt((af * af).sum(1)).max(initial=0) * np.sqrt((vf * vf).sum(1)).max(initial=0)
    return (af @ vf.T).astype(np.int64) if reach < 2**52 else a @ v.T  # sums of whole numbers are exact in floats below that


def _matched(row, same_label: bool):
    """For each window of a pair of blocks: its number, the scores, ids and copies of the rows with the wanted labels."""
    uid, ids, labels, copies = _longs(row.uids), _longs(row.ids), _longs(row.labels), _longs(row.copies)
    anchor, own = _longs(row.anchors), _longs(row.owns)
    score = scores_of(_longs(row.adata).reshape(len(anchor), row.awidth), _longs(row.data).reshape(len(uid), row.width))
    last, found = -1, None
    for w, p in enumerate(_longs(row.place).tolist()):
        if p != last:  # the windows of an anchor follow one another
            keep = labels == own[p] if same_label else labels != own[p]
            itself = uid == anchor[p]
            times = copies
            if same_label and itself.any():  # an anchor isn't its own partner, but other rows with its id and vector are
                times = copies - itself
                keep &= times > 0
            last, found = p, (score[p][keep], ids[keep], times[keep])
        yield w, *found


def bucket_counts(values: np.ndarray, times: np.ndarray, high: int, low: int, need: int, digit: int, descending: bool):
    """The histogram of ``values`` within low..high by their leading digit: bucket, its low and high value, rows.

    Buckets come in the order in which rows are taken. Those after the one that
    holds the ``need``-th row here can't hold the ``need``-th of all, and are left out.
    """
    inside = (values >= low) & (values <= high)
    shift = max(0, (high - low).bit_length() - digit)
    unsigned = values[inside].astype(np.uint64)  # differences below 2**64 whatever the signs
    with np.errstate(over="ignore"):
        far = np.uint64(high % 2**64) - unsigned if descending else unsigned - np.uint64(low % 2**64)
    n = np.bincount((far >> np.uint64(shift)).astype(np.int64), weights=times[inside]).astype(np.int64)
    upto = int(np.searchsorted(np.cumsum(n), need)) + 1
    for b in np.flatnonzero(n[:upto]).tolist():
        begin, end = b << shift, ((b + 1) << shift) - 1
        yield (b, max(high - end, low), high - begin, int(n[b])) if descending else (b, low + begin, min(low + end, high), int(n[b]))


def select_first(anchors: DataFrame, blocks: DataFrame, windows: DataFrame, ids: tuple[int, int], slots: int, how: Selection) -> DataFrame:
    """The first ``how.k`` rows of each window by score (descending) and id: wid, id, score, rank; repeated rows count each.

    ``windows``: wid, anchor, top, bottom. ``ids``: the least and the greatest id.
    """
    spark = anchors.sparkSession
    columns = [c.split()[0] for c in _WINDOW.split(", ")]
    state = windows.select(
        "wid", "anchor", "top", "bottom", F.lit(False).alias("by_id"), F.col("top").alias("high"), F.col("bottom").alias("low"),
        F.lit(how.k).cast("long").alias("need"), F.col("bottom").alias("least"), F.lit(MOST).alias("cut"), F.lit(False).alias("done"),
    )
    state = staged(state.select(*columns), "windows")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                wid, by_id, high, low, need, least = (_longs(getattr(row, c)).tolist() for c in ("wid", "by_id", "high", "low", "need", "least"))
                out = []
                for w, score, vid, times in _matched(row, how.same_label):
                    if by_id[w]:
                        here = score == least[w]
                        counted = bucket_counts(vid[here], times[here], high[w], low[w], need[w], how.digit, False)
                    else:
                        counted = bucket_counts(score, times, high[w], low[w], need[w], how.digit, True)
                    out += [(wid[w], *c) for c in counted]
                yield pd.DataFrame(out, columns=["wid", "bucket", "from_low", "to_high", "n"])

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                wid, top, least, cut = (_longs(getattr(row, c)) for c in ("wid", "top", "least", "cut"))
                found = []
                for w, score, vid, times in _matched(row, how.same_label):
                    ok = np.flatnonzero((score >= least[w]) & (score <= top[w]))
                    if cut[w] != MOST:
                        ok = ok[(score[ok] > least[w]) | (vid[ok] <= cut[w])]
                    if len(ok):
                        found.append((np.full(len(ok), wid[w]), vid[ok], score[ok], times[ok]))
                if found:
                    yield pd.DataFrame(dict(zip(("wid", "id", "score", "times"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    def met(asked: DataFrame) -> DataFrame:
        return _anchor_blocks(anchors, asked, slots).join(blocks, "slot").drop("slot")

    while not state.filter(~F.col("done")).isEmpty():
        parts = met(state.filter(~F.col("done"))).mapInPandas(count, "wid long, bucket long, from_low long, to_high long, n long")
        sums = parts.groupBy("wid", "bucket").agg(F.sum("n").alias("n"), F.first("from_low").alias("from_low"), F.first("to_high").alias("to_high"))
        upto = Window.partitionBy("wid").orderBy("bucket")
        located = sums.withColumn("upto", F.sum("n").over(upto)).join(state.select("wid", F.col("need").alias("wanted")), "wid")
        located = located.filter((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted"))).drop("wanted", "bucket")
        s = state.filter(~F.col("done")).join(located, "wid", "left")
        found = F.col("upto").isNotNull()  # else the range holds fewer rows than wanted, and all of them qualify
        left = F.col("need") - (F.col("upto") - F.col("n"))
        few = F.lit(how.k) - left + F.col("n") <= F.lit(how.spare)
        one = F.col("from_low") == F.col("to_high")
        to_ids = found & ~F.col("by_id") & ~few & one
        stepped = s.select(
            "wid", "anchor", "top", "bottom",
            (F.col("by_id") | F.coalesce(to_ids, F.lit(False))).alias("by_id"),
            F.when(to_ids, F.lit(ids[1])).otherwise(F.coalesce("to_high", "high")).alias("high"),
            F.when(to_ids, F.lit(ids[0])).otherwise(F.coalesce("from_low", "low")).alias("low"),
            F.when(found, left).otherwise(F.col("need")).alias("need"),
            F.when(found & ~F.col("by_id"), F.col("from_low")).otherwise(F.col("least")).alias("least"),
            F.when(found & F.col("by_id"), F.col("to_high")).otherwise(F.col("cut")).alias("cut"),
            F.coalesce(~found | few | (one & F.col("by_id")), F.lit(False)).alias("done"),
        )
        state = staged(state.filter("done").union(stepped.select(*columns)), "windows")
    rows = met(state).mapInPandas(gather, "wid long, id long, score long, times long").groupBy("wid", "id", "score").agg(F.sum("times").alias("times"))
    order = Window.partitionBy("wid").orderBy(F.col("score").desc(), "id")
    each = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(how.k)).cast("int")))).drop("copy", "times")
    return staged(each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= how.k), "selected")


def mine(
    items: DataFrame, is_anchor: Column, k: int = 10, positives: int = 5, low: int = 30, high: int = 90,
    id_col: str = "vec_id", vector: str = "v", label: str = "label", digit: int = 8, spare: int = 64,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``vector`` holds whole numbers (see ``topk.quantised``). Rows without id,
    label or vector take no part. The score is the inner product (it must fit a
    long), higher ones come first, ties go to the smaller id. An anchor's
    positives are its first ``positives`` other rows of its label; for each, the
    first ``k`` rows of other labels whose score is ``low`` to ``high`` percent of
    the positive's are returned. A positive without any, and an anchor without
    positives, has no rows; a negative positive score leaves no window.

    Rows that repeat an id are rows of their own, as anchors, positives and
    negatives; those that repeat id, label and vector are told apart by number
    only. No other column is read. Shorter vectors count as filled with zeros. No
    rows give no rows. The driver holds four figures of the table.
    """
    spark = items.sparkSession
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), F.col(label).cast("long").alias("label"), is_anchor.alias("anchor"))
    rows = rows.filter("id IS NOT NULL AND v IS NOT NULL AND label IS NOT NULL")
    rows = rows.groupBy("id", "label", "v").agg(F.max("anchor").alias("anchor"), F.count(F.lit(1)).alias("copies"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = staged(rows.withColumn("norm", norm).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    n, first_id, last_id, longest = rows.agg(F.count(F.lit(1)), F.min("id"), F.max("id"), F.max("norm")).first()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    slots = max(n_salts(spark), -(-n // (64 * ITEM_BLOCK)))
    blocks = staged(_item_blocks(rows, slots), "blocks")
    anchors = rows.filter("anchor").select("uid", "id", "label", "copies", "v", "norm")
    ids = (first_id, last_id)
    reach = F.least(F.ceil(F.col("norm") * F.lit(longest * (1 + 1e-9)) + 1), F.lit(1 << 62))
    whole = anchors.select(F.col("uid").alias("wid"), F.col("uid").alias("anchor"), reach.alias("top"), (-reach).alias("bottom"))
    near = select_first(anchors, blocks, whole, ids, slots, Selection(positives, True, digit, max(spare, positives)))
    near = near.select(F.col("wid").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # positives with equal scores open the same window
    bounds = near.select("anchor", "positive_score").distinct()
    share = lambda percent: F.col("positive_score").cast("decimal(20,0)") * F.lit(percent) / F.lit(100)
    bounds = bounds.withColumn("top", F.floor(share(high)).cast("long")).withColumn("bottom", F.ceil(share(low)).cast("long"))
    windows = staged(bounds.filter("bottom <= top").withColumn("wid", F.monotonically_increasing_id()), "bounds")
    hard = select_first(anchors, blocks, windows, ids, slots, Selection(k, False, digit, max(spare, k)))
    found = hard.join(windows.select("wid", "anchor", "positive_score"), "wid").join(near, ["anchor", "positive_score"])
    found = found.join(anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"), "copies"), "anchor")
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
