"""Unigram encoding and decoding of SentencePiece vocabularies (operator 3).

The best segmentation is the path with the highest sum of log scores (Viterbi),
over a double-array trie of the pieces' UTF-8. Characters that no piece covers
become byte pieces. Blanks are written as the marker U+2581, with one in front
of the text; decoding joins pieces and bytes and turns markers into blanks, so
that a U+2581 of the text itself comes back as a blank.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
#: An unknown character scores this much below the least piece.
UNKNOWN_PENALTY = 10.0
#: Segmentations of text chunks that a worker remembers, each of a chunk of at most so many bytes.
CACHE, CACHED_BYTES = 400_000, 256
#: Positions times chunks that are segmented in step at a time, at some 20 bytes each.
CELLS = 2_000_000


class DoubleArray:
    """A trie in two arrays: the child of node s by byte b is base[s] + b, if check there is s.

    Built level by level from sorted keys; ``value`` is a key's number, or -1.
    """

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for number, key in enumerate(keys):
            node = 0
            for b in key:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                node = nxt
            ends[node] = number
        size = 4 * len(children) + 8192
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        flags = bytearray(size)
        flags[0] = 1
        taken = np.frombuffer(flags, np.bool_)  # the same memory
        queue = [(0, 0)]
        free = 1  # no slot before it is free
        for plain, slot in queue:
            if plain in ends:
                value[slot] = ends[plain]
            below = children[plain]
            if not below:
                continue
            codes = np.fromiter(below, np.int64, len(below))
            low = int(codes.min())
            free = start = flags.find(0, free)
            while True:  # the first place where all children's slots are free
                if start + 4096 > size:  # room for another stretch of places and for what lies behind the last of them
                    base, check, value = (np.concatenate([a, np.full(size, fill, np.int32)]) for a, fill in ((base, 0), (check, -1), (value, -1)))
                    flags = bytearray(taken.tobytes()) + bytes(size)
                    taken, size = np.frombuffer(flags, np.bool_), 2 * size
                places = np.flatnonzero(~taken[start : start + 2048]) + start - low
                places = places[places > 0]
                fits = np.flatnonzero(~taken[places[:, None] + codes].any(axis=1))
                if len(fits):
                    break
                start += 2048
            at = int(places[fits[0]])
            base[slot] = at
            taken[at + codes] = True
            check[at + codes] = slot
            queue.extend((child, at + b) for b, child in below.items())
        used = int(np.flatnonzero(taken).max()) + 257
        self.base, self.check, self.value = (np.ascontiguousarray(a[:used]) for a in (base, check, value))


@dataclass(frozen=True)
class Vocabulary:
    """What encoding and decoding need; small (the pieces of one model), so that it can go with the tasks."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]  # of matchable pieces; -inf for others
    byte_ids: tuple[int, ...]  # the ids of <0x00> to <0xFF>, or ()
    unknown: int
    base: bytes
    check: bytes
    value: bytes


def load(model_file: str, scores: str = "zipf") -> Vocabulary:
    """Read a SentencePiece model file, on the driver only.

    ``scores``: "model" takes the file's scores as log scores. A merge-based
    model's scores are merge ranks, not log probabilities; "zipf" turns a rank
    into the log of a frequency that falls with it, -ln(rank + 10).
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.vocab_size()
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    value = {i: sp.get_score(i) for i in plain}
    if scores == "zipf":
        value = {i: -math.log(rank + 10) for rank, i in enumerate(sorted(plain, key=lambda i: (-value[i], i)))}
    value = {i: float(np.float32(v)) for i, v in value.items()}
    byte_ids = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
    return vocabulary([sp.id_to_piece(i) for i in range(n)], value, tuple(byte_ids[f"<0x{b:02X}>"] for b in range(256)) if byte_ids else (), sp.unk_id())


def vocabulary(pieces: list[str], scores: dict[int, float], byte_ids: tuple[int, ...], unknown: int) -> Vocabulary:
    """From pieces and the log scores of those that text can match."""
    ids = sorted(scores, key=lambda i: pieces[i].encode())
    trie = DoubleArray([pieces[i].encode() for i in ids])
    value = np.where(trie.value >= 0, np.array(ids, np.int32)[trie.value], -1).astype(np.int32)
    return Vocabulary(
        tuple(pieces), tuple(scores.get(i, -math.inf) for i in range(len(pieces))), byte_ids, unknown, trie.base.tobytes(), trie.check.tobytes(), value.tobytes()
    )


def _packed(ids) -> bytes:
    return array("i", ids).tobytes()


class Codec:
    def __init__(self, v: Vocabulary):
        self.v = v
        self.base, self.check, self.value = (np.frombuffer(a, np.int32).tolist() for a in (v.base, v.check, v.value))
        self.arrays = [*(np.frombuffer(a, np.int32) for a in (v.base, v.check, v.value)), np.array(v.scores)]
        self.unknown_score = min((s for s in v.scores if s > -math.inf), default=0.0) - UNKNOWN_PENALTY
        matchable = [p for p, s in zip(v.pieces, v.scores, strict=True) if s > -math.inf]
        # A piece never goes over a border between another character and a marker, nor holds a line end, unless
        # the vocabulary has such pieces. Then chunks cut there can be segmented each for itself, with the same result.
        apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in matchable)
        line = "\n" if not any("\n" in p for p in matchable) else ""
        self.chunks = re.compile(f"{MARK}*[^{MARK}{line}]+|{MARK}+" + (f"|{line}" if line else "") if apart else "(?s).+").findall
        self.cache: dict[str, bytes] = {}  # a chunk's ids as 32-bit numbers in a row
        self.long: list[str] = []  # chunks that are forgotten after their batch
        self.spelled = [p.encode() for p in v.pieces]
        for b, i in enumerate(v.byte_ids):
            self.spelled[i] = bytes([b])
        for i, (p, s) in enumerate(zip(v.pieces, v.scores, strict=True)):
            if s == -math.inf and i not in v.byte_ids:
                self.spelled[i] = " ⁇ ".encode() if i == v.unknown else b""

    def _segment(self, chunk: str) -> array:
        """Viterbi over byte positions, 16 bytes of memory for each; of equal paths the one whose last piece is longer."""
        data, base, check, value, scores = chunk.encode(), self.base, self.check, self.value, self.v.scores
        n = len(data)
        best, came, by = array("d", [-math.inf]) * (n + 1), array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            first = data[at]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            here, node, i, single = best[at], 0, at, False
            while i < n:
                nxt = base[node] + data[i]
                if check[nxt] != node or nxt == 0:
                    break
                node = nxt
                i += 1
                piece = value[node]
                if piece >= 0:
                    score = here + scores[piece]
                    if score > best[i]:
                        best[i], came[i], by[i] = score, at, piece
                    if i - at == width:
                        single = True
            if not single:
                i = at + width
                score = here + self.unknown_score
                if score > best[i]:
                    best[i], came[i], by[i] = score, at, -1
            at += width
        path = array("i")
        at = n
        while at:
            start = came[at]
            if by[at] >= 0:
                path.append(by[at])
            elif self.v.byte_ids:
                path.extend(self.v.byte_ids[b] for b in reversed(data[start:at]))
            elif not (path and path[-1] == self.v.unknown):
                path.append(self.v.unknown)
            at = start
        path.reverse()
        return path

    def split(self, text: str) -> list[str]:
        """The text as pieces write it, in chunks that can be segmented each for itself."""
        return self.chunks(MARK + text.replace(" ", MARK))

    def remember(self, chunks: set[str]) -> None:
        """Segment the chunks that the cache lacks: those of like length many at a time, as many as ``CELLS`` allow, long ones each for itself."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = list(chunks.difference(self.cache))
        data = [c.encode() for c in new]
        size = np.fromiter(map(len, data), np.int64, len(data))
        self.long += [c for c, n in zip(new, size.tolist(), strict=True) if n > CACHED_BYTES]
        order = np.argsort(size, kind="stable")
        ascending = size[order]
        start = 0
        while start < len(order):
            # the longest has at most twice the bytes of the shortest, and memory is that of the longest for each
            alike = int(np.searchsorted(ascending, 2 * ascending[start] + 8, "right"))
            cells = ascending[start : min(alike, start + 20_000)] * np.arange(1, min(alike, start + 20_000) - start + 1)
            stop = start + max(1, int(np.searchsorted(cells, CELLS, "right")))
            part = order[start:stop].tolist()
            if len(part) < 16 or ascending[start] > CELLS // 16:
                self.cache.update((new[i], _packed(self._segment(new[i]))) for i in part)
            else:
                self._segment_many([new[i] for i in part], [data[i] for i in part], size[order[start:stop]])
            start = stop

    def _segment_many(self, chunks: list[str], data: list[bytes], size: np.ndarray) -> None:
        """The Viterbi of ``_segment`` for many chunks in step, position by position; ``size`` ascends."""
        m, longest = len(chunks), int(size[-1])
        # a row for each position, so that a step reads and writes within one row
        codes = np.ascontiguousarray(np.frombuffer(b"".join(d.ljust(longest + 1, b"\0") for d in data), np.uint8).reshape(m, longest + 1).T)
        base, check, value, scores = self.arrays
        best = np.full((longest + 5, m), -np.inf)
        came, by = np.zeros((longest + 5, m), np.int32), np.full((longest + 5, m), -1, np.int32)
        best[0] = 0.0
        for at in range(longest):
            here = best[at]
            active = np.flatnonzero((here > -np.inf) & (size > at))
            if not len(active):
                continue
            rows, node, i = active, None, at
            first = codes[at][rows]
            width = 1 + (first >= 0xC0).astype(np.int64) + (first >= 0xE0) + (first >= 0xF0)
            ends = np.zeros(m, np.int64)
            ends[rows] = at + width
            single = np.zeros(m, bool)
            while len(rows):
                nxt = codes[i][rows] + (base[node] if node is not None else base[0])
                go = np.flatnonzero((check[nxt] == (node if node is not None else 0)) & (size[rows] > i) & (nxt > 0))
                rows, node = rows[go], nxt[go]
                i += 1
                piece = value[node]
                hit = np.flatnonzero(piece >= 0)
                if not len(hit):
                    continue
                r, piece = rows[hit], piece[hit]
                single[r] |= ends[r] == i
                score = here[r] + scores[piece]
                better = np.flatnonzero(score > best[i][r])
                r = r[better]
                best[i][r], came[i][r], by[i][r] = score[better], at, piece[better]
            r = active[~single[active]]
            if len(r):
                end, score = ends[r], here[r] + self.unknown_score
                better = score > best[end, r]
                r, end = r[better], end[better]
                best[end, r], came[end, r], by[end, r] = score[better], at, -1
        # all paths at once, from the ends of the chunks
        at, steps = size.copy(), []
        while True:
            open_rows = np.flatnonzero(at)
            if not len(open_rows):
                break
            step = np.full(m, -2, np.int32)
            step[open_rows] = by[at[open_rows], open_rows]
            at[open_rows] = came[at[open_rows], open_rows]
            steps.append(step)
        paths = np.stack(steps[::-1], axis=1)
        used = paths != -2
        ids, ends = paths[used].tobytes(), np.cumsum(4 * used.sum(axis=1)).tolist()
        plain = (paths != -1).all(axis=1).tolist()
        begin, cache = 0, self.cache
        for chunk, end, good in zip(chunks, ends, plain, strict=True):
            cache[chunk] = ids[begin:end] if good else _packed(self._segment(chunk))
            begin = end

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin and end (one number more than texts)."""
        split = [self.split(t) if t else [] for t in texts]
        self.remember(set(chain.from_iterable(split)))
        cached = self.cache.__getitem__
        found = [b"".join(map(cached, chunks)) for chunks in split]
        for chunk in self.long:
            del self.cache[chunk]
        self.long = []
        return np.frombuffer(b"".join(found), np.int32), np.cumsum([0, *map(len, found)]) // 4

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_all(self, lists: pa.ListArray) -> pa.Array:
        """Texts of lists of ids. Spelled bytes are joined by Arrow; only texts that aren't UTF-8 are decoded one by one."""
        flat = pa.array(self.spelled, pa.binary()).take(lists.flatten())
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat), pa.scalar(b"", pa.binary()))
        try:
            texts = pc.replace_substring(whole.cast(pa.string()), MARK, " ")
        except pa.ArrowInvalid:
            return pa.array([None if x is None else self.decode(x) for x in lists.to_pylist()], pa.string())
        texts = pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)
        return pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), texts) if lists.null_count else texts

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_codecs: dict[int, Codec] = {}


def codec(v: Vocabulary) -> Codec:
    """The worker's codec of a vocabulary, with what it has cached."""
    key = hash((v.pieces, v.scores))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(v)
    return _codecs[key]


def encoded(docs: DataFrame, v: Vocabulary, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` array<int> and ``n_bytes`` int, the ids that are byte pieces.

    Whole texts are encoded. Null gives null ids; an empty text gives none.
    Columns named ``ids`` or ``n_bytes`` are replaced. Rows are encoded where
    they are, without a shuffle; a worker holds one batch of texts, some 20 bytes
    for each of a chunk's, and a bounded cache. Repeated rows are encoded each.
    """
    docs = docs.drop("ids", "n_bytes")
    shared = docs.sparkSession.sparkContext.broadcast(v)
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_bytes", T.IntegerType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        is_byte = np.zeros(len(c.v.pieces) + 1, np.int64)
        is_byte[list(c.v.byte_ids)] = 1
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                texts = batch.column(text)
                ids, ends = c.encode_all(texts.to_pylist())
                counts = np.concatenate([[0], np.cumsum(is_byte[ids])])
                n_bytes = pa.array(counts[ends[1:]] - counts[ends[:-1]], pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                if texts.null_count:
                    lists = pc.if_else(texts.is_null(), pa.scalar(None, lists.type), lists)
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, n_bytes], names=[*batch.schema.names, "ids", "n_bytes"])

    return docs.mapInArrow(encode, schema)


def decoded(rows: DataFrame, v: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids``. Null gives null. Bytes that aren't UTF-8 become U+FFFD, a U+2581 of the encoded text a blank."""
    rows = rows.drop(out)
    shared = rows.sparkSession.sparkContext.broadcast(v)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                texts = c.decode_all(batch.column(ids))
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, out])

    return rows.mapInArrow(decode, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))
