"""Removal of long repeated strings by run-length BWT indexes (operator 6).

A byte goes if it lies in a string of ``length`` bytes that starts anywhere else
too. Three steps find those bytes:

1. Every string of ``length`` bytes is filed under its minimizer, the ``gram``
   bytes in it with the least hash. Equal strings have equal minimizers at equal
   offsets. Neighbouring strings with one minimizer form a window; windows with
   equal bytes are told by their hash, and are repeated whole. Minimizers that
   occur once are done with.
2. The distinct windows of each other minimizer go to an index: windows are
   concatenated, suffix-sorted, and the Burrows-Wheeler transform is kept as
   runs. Suffix positions and lengths of common prefixes are sampled at the ends
   of runs; between samples the matching statistics fall by one with each byte,
   so one pass over the text streams them, and starts that match ``length``
   bytes or more are marked. Minimizers are dealt over shards of bounded size.
3. Marked stretches of a document are united and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, staged

#: Bytes of a document that are hashed at a time.
SEGMENT = 1 << 22


@dataclass(frozen=True)
class Repeats:
    """hot: most distinct windows of one minimizer that one index takes; the strings of others are compared by hash. shard_bytes: text of an index."""

    length: int = 200
    gram: int = 40
    hot: int = 4000
    shard_bytes: int = 1 << 20
    seed: int = 5


def _tables(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return tuple(rng.integers(0, 2**64, 256, np.uint64) for _ in range(2))


class Roller:
    """Hashes of substrings: prefix sums of random numbers for bytes times powers, modulo 2^64, moved to a common power and scrambled."""

    FACTOR = 0x9E3779B97F4A7C15

    def __init__(self, table: np.ndarray):
        self.table = table
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        inverse = pow(self.FACTOR, -1, 1 << 64)
        self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, f, np.uint64)])) for f in (self.FACTOR, inverse))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            self._grow(2 * len(data))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.table[data] * self.up[: len(data)], dtype=np.uint64)])

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (prefix[end] - prefix[start]) * self.down[start]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        return x ^ (x >> np.uint64(29))


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours: minima from the left and from the right within blocks of ``w`` meet."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def windows_of(data: np.ndarray, plan: Repeats, rolls: tuple[Roller, Roller]):
    """Per window: minimizer hash, hash of the window and its offset, first start, starts - 1. Every start lies in one window."""
    out = []
    length, gram = plan.length, plan.gram
    for base in range(0, len(data) - length + 1, SEGMENT):
        part = data[base : base + SEGMENT + length - 1]
        first, second = (r.prefix(part) for r in rolls)
        starts = np.arange(len(part) - gram + 1)
        hashes = rolls[0].of(first, starts, starts + gram)
        low = _window_min((hashes & np.uint64(0xFFFFFFFFFF000000)) | starts.astype(np.uint64), length - gram + 1)
        at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([begin[1:], [len(at)]]) - 1
        whole = rolls[1].of(second, begin, last + length) * np.uint64(2654435761) + (at[begin] - begin).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + (last - begin).astype(np.uint64)
        out.append((hashes[at[begin]], whole, begin + base, last - begin))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


_ROW = "k long, th long, fp long, wh long, s long, n int, sure boolean"


def _filed(docs: DataFrame, plan: Repeats) -> DataFrame:
    """The windows of all documents. Of equal windows in one batch all but two are ``sure`` to be repeated and needn't meet the others."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolls = tuple(Roller(t) for t in _tables(plan.seed))
        for batch in batches:
            found = []
            for k, th, body in zip(*(batch.column(c).to_pylist() for c in ("k", "th", "body")), strict=True):
                if len(body) >= plan.length:
                    w = windows_of(np.frombuffer(body, np.uint8), plan, rolls)
                    found.append((np.full(len(w[0]), k), np.full(len(w[0]), th), *w))
            if not found:
                continue
            k, th, fp, wh, s, n = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((wh, fp))
            new = np.concatenate([[True], (fp[order][1:] != fp[order][:-1]) | (wh[order][1:] != wh[order][:-1])])
            begin = np.flatnonzero(new)
            place = np.arange(len(order)) - np.repeat(begin, np.diff([*begin, len(order)]))
            sure = np.zeros(len(order), bool)
            sure[order] = place >= 2
            columns = (k, th, fp.view(np.int64), wh.view(np.int64), s, n.astype(np.int32), sure)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "th", "fp", "wh", "s", "n", "sure"])

    return docs.select("k", "th", "body").mapInArrow(file, _ROW)


def _told_apart(rows: DataFrame) -> DataFrame:
    """k, th, fp, s, n, whole, member: windows whose bytes occur twice (``whole``), and one of each distinct window (``member``) where a minimizer has several.

    Rows pass in the order of minimizer and window hash with one row held back,
    so no minimizer needs memory, however often it occurs.
    """
    names = ["k", "th", "fp", "wh", "s", "n", "sure"]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last row so far, not yet told
        before: tuple[int, int] | None = None  # the row before that one
        runs = 0  # distinct windows of its minimizer up to that one

        def out(cols: list[np.ndarray], nxt: tuple[int, int] | None) -> pa.RecordBatch:
            nonlocal before, runs
            fp, wh = cols[2], cols[3]
            f = np.concatenate([[before[0] if before else ~fp[0]], fp, [nxt[0] if nxt else ~fp[-1]]])
            w = np.concatenate([[before[1] if before else ~wh[0]], wh, [nxt[1] if nxt else ~wh[-1]]])
            same_f = f[1:] == f[:-1]
            same_w = same_f & (w[1:] == w[:-1])
            # number of the row's run among the runs of its minimizer
            starts_f, starts_w = ~same_f[:-1], ~same_w[:-1]
            total = np.cumsum(starts_w)
            base = np.maximum.accumulate(np.where(starts_f, total, 0))
            run = np.where(base > 0, total - base + 1, total + runs)
            whole = same_w[:-1] | same_w[1:]
            member = ~same_w[1:] & (same_f[1:] | (run > 1))
            before, runs = (fp[-1], wh[-1]), int(run[-1])
            keep = whole | member
            arrays = [pa.array(cols[i][keep]) for i in (0, 1, 2, 4, 5)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(whole[keep]), pa.array(member[keep])], names=["k", "th", "fp", "s", "n", "whole", "member"])

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            sure = cols[6].astype(bool)
            if sure.any():
                arrays = [pa.array(cols[i][sure]) for i in (0, 1, 2, 4, 5)]
                n = int(sure.sum())
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.ones(n, bool)), pa.array(np.zeros(n, bool))], names=["k", "th", "fp", "s", "n", "whole", "member"])
            cols = [c[~sure] for c in cols[:6]]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            held = [c[-1:] for c in cols]
            if len(cols[0]) > 1:
                yield out([c[:-1] for c in cols], (int(held[2][0]), int(held[3][0])))
        if held is not None:
            yield out(held, None)

    # sure rows only pass: they are dealt by place
    route = F.when(F.col("sure"), F.xxhash64("k", "th", "s")).otherwise(F.col("fp"))
    dealt = rows.withColumn("route", route).repartition("route").sortWithinPartitions("fp", "wh").select(*names)
    return dealt.mapInArrow(tell, "k long, th long, fp long, s long, n int, whole boolean, member boolean")


class RunLengthIndex:
    """Run-length BWT of texts, each ended by a mark of its own, with samples at run ends.

    ``head``/``tail``: places where runs begin / end in suffix order; ``sa_head``,
    ``sa_tail``: the suffixes there; ``up``/``down``: the common prefix of that
    suffix with its neighbour outside the run.
    """

    def __init__(self, texts: list[bytes]):
        self.text = text = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
        sizes = np.array([len(t) for t in texts])
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        n = len(text)
        self.end = np.repeat(self.starts + sizes, sizes + 1)  # of the own text
        sa = self._sorted(n, int(sizes.max()))
        symbol = text[sa - 1].astype(np.int64)
        first = np.zeros(n, bool)
        first[self.starts] = True
        symbol[first[sa]] = 256 + np.arange(int(first.sum()))  # marks differ from each other
        change = symbol[1:] != symbol[:-1]
        heads, tails = np.flatnonzero(np.concatenate([[True], change])), np.flatnonzero(np.concatenate([change, [True]]))
        self.symbols, self.lengths = symbol[heads], tails - heads + 1
        self.sa_head, self.sa_tail = sa[heads], sa[tails]
        self.up, self.down = np.zeros(len(heads), np.int64), np.zeros(len(tails), np.int64)
        if len(heads) > 1:
            self.up[1:] = self.down[:-1] = self._common(sa[heads[1:]], sa[tails[:-1]])

    def _sorted(self, n: int, longest: int) -> np.ndarray:
        """Suffix array by prefix doubling, from seven bytes on; equal suffixes in text order, as their marks are."""
        at = np.arange(n)
        left = self.end - at
        key = np.zeros(n, np.int64)
        for i in range(7):
            here = np.minimum(at + i, n - 1)
            key = (key << 9) | np.where(i < left, self.text[here].astype(np.int64) + 1, 0)
        sa = np.argsort(key, kind="stable")
        ordered = key[sa]
        rank = np.empty(n, np.int64)
        step = 7
        while True:
            rank[sa] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
            if step >= longest + 1 or rank[sa[-1]] == n:
                return sa
            rest = np.where(step < left, rank[np.minimum(at + step, n - 1)], 0)
            # only suffixes that aren't told apart yet are sorted again, within their group
            r = rank[sa]
            tied = np.zeros(n, bool)
            same = r[1:] == r[:-1]
            tied[1:] |= same
            tied[:-1] |= same
            places = np.flatnonzero(tied)
            if not len(places):
                return sa
            group = sa[places]
            order = np.argsort(r[places] * (n + 1) + rest[group], kind="stable")
            sa[places] = group[order]
            ordered = rank[sa] * (n + 1) + np.where(tied, rest[sa], 0)
            step *= 2

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of common prefixes of pairs of suffixes, up to their marks."""
        size = np.zeros(len(a), np.int64)
        most = np.minimum(self.end[a] - a, self.end[b] - b)
        live = np.arange(len(a))
        while len(live):
            i = size[live]
            width = 32
            offsets = i[:, None] + np.arange(width)
            x, y = (self.text[np.minimum(p[live][:, None] + offsets, len(self.text) - 1)] for p in (a, b))
            equal = (x == y) & (offsets < most[live][:, None])
            run = np.where(equal.all(axis=1), width, np.argmin(equal, axis=1))
            size[live] += run
            live = live[run == width]
        return size

    def matching(self) -> np.ndarray:
        """For every place in the text, how long it matches another place: a sample where a run ends, one less with each byte after."""
        n = len(self.text)
        best = np.zeros(n, np.int64)
        for places, values in ((self.sa_head, self.up), (self.sa_tail, self.down)):
            sample = np.full(n, -1, np.int64)
            sample[places] = np.arange(len(places))
            here = np.maximum.accumulate(np.where(sample >= 0, np.arange(n), -1))
            known = here >= 0
            at = np.maximum(here, 0)
            best = np.maximum(best, np.where(known, values[sample[at]] - (np.arange(n) - at), 0))
        return best


def _marked(windows: DataFrame, plan: Repeats) -> DataFrame:
    """k, th, s, e: stretches that a shard's index finds repeated."""

    def index(table: pa.Table) -> pa.Table:
        table = table.sort_by([("fp", "ascending"), ("k", "ascending"), ("th", "ascending"), ("s", "ascending")])
        texts = table.column("body").to_pylist()
        found = RunLengthIndex(texts)
        long = found.matching() >= plan.length
        edge = np.diff(np.concatenate([[0], long.astype(np.int8), [0]]))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1  # first and last start of each stretch
        which = np.searchsorted(found.starts, lo, "right") - 1
        s = table.column("s").to_numpy()[which] + lo - found.starts[which]
        take = pa.array(which)
        return pa.table({"k": table.column("k").take(take), "th": table.column("th").take(take), "s": pa.array(s, pa.int64()), "e": pa.array(s + hi - lo + plan.length, pa.int64())})

    return windows.groupBy("shard").applyInArrow(index, "k long, th long, s long, e long")


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Add __k, __th: 128 bits that tell a row by its id (null is an id of its own) and text, the same for rows that repeat both."""
    parts = (F.col(id_col).isNull(), F.col(id_col), F.col(text).isNull(), F.col(text))
    return docs.withColumn("__k", F.xxhash64(F.lit("k"), *parts)).withColumn("__th", F.xxhash64(F.lit("th"), *parts))


def repeated_spans(docs: DataFrame, plan: Repeats = Repeats(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """k, th, spans: for each document (see ``_keyed``) with repeated strings the stretches of bytes to remove, united and in order."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = _keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text").select(F.col("__k").alias("k"), F.col("__th").alias("th"), body.alias("body"))
    hits = staged(_told_apart(_filed(rows, plan)), "windows")
    marks = hits.filter("whole").select("k", "th", "s", (F.col("s") + F.col("n") + plan.length).alias("e"))

    members = hits.filter("member")
    crowds = staged(members.groupBy("fp").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > plan.hot), "crowds")
    shards = max(1, -(-(members.agg(F.sum(F.col("n") + plan.length)).first()[0] or 0) // plan.shard_bytes))
    at = members.join(crowds, "fp", "left").groupBy("k", "th").agg(F.collect_set(F.struct("fp", "s", "n", F.col("c").isNotNull().alias("crowd"))).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, th, body, at in zip(*(batch.column(c).to_pylist() for c in ("k", "th", "body", "at")), strict=True):
                for i in range(0, len(at), 2000):
                    part = at[i : i + 2000]
                    columns = [
                        pa.array([k] * len(part), pa.int64()), pa.array([th] * len(part), pa.int64()),
                        *(pa.array([x[c] for x in part], kind) for c, kind in (("fp", pa.int64()), ("s", pa.int64()), ("n", pa.int32()), ("crowd", pa.bool_()))),
                        pa.array([body[x["s"] : x["s"] + x["n"] + plan.length] for x in part], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["k", "th", "fp", "s", "n", "crowd", "body"])

    # rows that repeat id and text have the same windows: one of them is enough
    texts = rows.join(at, ["k", "th"]).mapInArrow(cut, "k long, th long, fp long, s long, n int, crowd boolean, body binary")
    any_crowd = not crowds.isEmpty()
    if any_crowd:
        texts = staged(texts, "window-texts")
    shard = F.pmod(F.xxhash64("fp"), F.lit(shards))
    marks = marks.union(_marked(texts.filter("NOT crowd").dropDuplicates(["k", "th", "s"]).withColumn("shard", shard).drop("crowd"), plan))
    if any_crowd:
        marks = marks.union(_crowded(texts.filter("crowd"), plan))
    spans = marks.groupBy("k", "th").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans")
            s, e = (lists.values.field(c).to_numpy(zero_copy_only=False) for c in ("s", "e"))
            out = []
            for lo, hi in zip(lists.offsets[:-1].to_pylist(), lists.offsets[1:].to_pylist(), strict=True):
                reach = np.maximum.accumulate(e[lo:hi])
                new = np.concatenate([[True], s[lo + 1 : hi] > reach[:-1]])  # begins after all before it have ended
                last = np.concatenate([np.flatnonzero(new)[1:] - 1, [hi - lo - 1]])
                out.append([{"s": a, "e": b} for a, b in zip(s[lo:hi][new].tolist(), reach[last].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("th"), pa.array(out, lists.type)], names=["k", "th", "spans"])

    return spans.mapInArrow(unite, spans.schema)


def _crowded(windows: DataFrame, plan: Repeats) -> DataFrame:
    """The same for minimizers with more distinct windows than an index takes: their strings are hashed one by one and told apart as windows are, at any number."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolls = tuple(Roller(t) for t in _tables(plan.seed + 1))
        for batch in batches:
            for k, th, s, n, body in zip(*(batch.column(c).to_pylist() for c in ("k", "th", "s", "n", "body")), strict=True):
                data = np.frombuffer(body, np.uint8)
                at = np.arange(n + 1)
                h = [r.of(r.prefix(data), at, at + plan.length).view(np.int64) for r in rolls]
                columns = [np.full(n + 1, k), np.full(n + 1, th), *h, s + at, np.zeros(n + 1, np.int32), np.zeros(n + 1, bool)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "th", "fp", "wh", "s", "n", "sure"])

    strings = windows.dropDuplicates(["k", "th", "s"]).mapInArrow(each, _ROW)
    return _told_apart(strings).filter("whole").select("k", "th", "s", (F.col("s") + plan.length).alias("e"))


def without_repeats(docs: DataFrame, plan: Repeats = Repeats(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``spans`` array<struct<s,e>> (bytes removed, end exclusive) and ``kept`` binary (the other bytes).

    Bytes are those of UTF-8, so a cut can fall inside a character. Null counts as
    empty. Strings never go over a document's end. Rows that repeat id and text
    count as different places, so they repeat each other. Columns named ``spans``
    or ``kept`` are replaced; an empty table gives an empty result.
    """
    docs, names = aside(docs.drop("spans", "kept"))
    id_col, text = ({b: a for a, b in names.items()}.get(c, c) for c in (id_col, text))
    columns = docs.columns
    spans = staged(repeated_spans(docs, plan, id_col, text), "spans").withColumnsRenamed({"k": "__k", "th": "__th"})
    joined = _keyed(docs, id_col, text).join(spans, ["__k", "__th"], "left").select(*columns, "spans")
    schema = T.StructType([*docs.schema.fields, spans.schema["spans"], T.StructField("kept", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for body, found in zip(batch.column(text).cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                body = body or b""
                if found:
                    ends = [0, *(x["e"] for x in found)]
                    body = b"".join(body[a:b] for a, b in zip(ends, [*(x["s"] for x in found), len(body)], strict=True))
                kept.append(body)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.binary())], names=[*batch.schema.names, "kept"])

    return joined.mapInArrow(cut, schema).withColumnsRenamed(names)
