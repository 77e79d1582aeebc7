"""Near-duplicate detection: MinHash signatures and a multi-index Hamming join (operator 5).

A document's set of word shingles gives a signature of ``hashes`` symbols, 16 bits
each. Signatures are split into chunks. If two differ in at most 2 * chunks - 1
places, some chunk has at most one of the differences, by pigeonhole; so a
document is filed under every chunk with every one of its symbols left out (the
allowed chunk error), and such pairs meet under some key for certain. Links are
confirmed on the full shingle sets.

Equal sets are one node from the start. Under a key the members are linked to the
least of them first, and each document is confirmed against the nearest of these.
Components that hold a near pair after that are one cluster. In a cluster the
members outside its largest component are compared with all its members on the
full sets, in blocks. Tasks tell only links that unite components, so neither near
pairs nor links of a group are listed, and none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_min, n_salts, staged
from .components import components

WORD_CACHE = 300_000


@dataclass(frozen=True)
class NearDup:
    """words: of a shingle. similarity: least Jaccard in percent. Signatures that differ in ``reach`` places or fewer meet for certain and are checked on the full sets; pairs farther apart aren't checked. block: rows a task holds of a key, and sets in one group with a center's set."""

    words: int = 5
    similarity: int = 80
    hashes: int = 64
    chunks: int = 14
    seed: int = 11
    block: int = 400

    @property
    def reach(self) -> int:
        return 2 * self.chunks - 1

    def borders(self) -> np.ndarray:
        return np.array([self.hashes * i // self.chunks for i in range(self.chunks)])


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


class Forest:
    """Which components a task has united: held members, and those that stream past them."""

    def __init__(self):
        self.comps = np.empty(0, np.int64)  # of held members
        self.root = np.empty(0, np.int64)  # a held member's place for all members united with it
        self.place: dict[int, int] = {}  # component -> a held member united with it

    def hold(self, comps: np.ndarray) -> None:
        at = len(self.root)
        self.comps = np.concatenate([self.comps, comps])
        roots = []
        for i, c in enumerate(comps.tolist()):
            known = self.place.setdefault(c, at + i)
            roots.append(at + i if known == at + i else self.root[known] if known < at else roots[known - at])
        self.root = np.concatenate([self.root, np.array(roots, np.int64)])

    def meet(self, held: np.ndarray, comp: int) -> np.ndarray:
        """A member of ``comp`` goes with the held members at these places; returns one of them for each component that this unites it with."""
        roots, first = np.unique(self.root[held], return_index=True)
        known = self.place.get(comp)
        fresh = roots != (self.root[known] if known is not None else -1)
        if not fresh.any():
            return held[:0]
        everything = roots if known is None else np.append(roots, self.root[known])
        self.root[np.isin(self.root, everything)] = everything.min()
        self.place[comp] = int(held[0])
        return held[first[fresh]]


class Shingler:
    """Sets of hashed word shingles: ASCII letters lower-cased, words between ASCII white space."""

    def __init__(self, words: int):
        self.words = words
        self.factors = _mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
        self.cache: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; none without words, one for the whole sequence if it is shorter than a shingle."""
        found = text.encode().lower().split() if text else []
        if not found:
            return np.empty(0, np.uint64)
        cache = self.cache
        if len(cache) > WORD_CACHE:
            cache.clear()
        for w in set(found).difference(cache):
            cache[w] = xxhash.xxh3_64_intdigest(w)
        ids = np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
        k = min(self.words, len(ids))
        total = np.full(len(ids) - k + 1, 0 if k == self.words else k, np.uint64)
        for i in range(k):
            total += ids[i : len(ids) - k + 1 + i] * self.factors[i]
        return np.unique(_mix(total))


def _signature(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """16 bits of the least value of each hash function."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        least = np.minimum(least, ((shingles[i : i + 2048, None] ^ shifts) * factors).min(axis=0))
    return (_mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def signatures(docs: DataFrame, plan: NearDup, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits that tell equal sets), sig; both null for empty sets."""

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(plan.words)
        numbers = _mix(np.arange(1, 2 * plan.hashes + 1, dtype=np.uint64) + np.uint64(plan.seed << 20))
        factors, shifts = numbers[: plan.hashes] | np.uint64(1), numbers[plan.hashes :]
        for frame in frames:
            n, keys, sigs = [], [], []
            for t in frame["text"]:
                s = shingler.of(t)
                n.append(len(s))
                if not len(s):
                    keys.append(None)
                    sigs.append(None)
                    continue
                keys.append(np.array([_mix(s + np.uint64(1)).sum(), _mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(s))], np.uint64).tobytes())
                sigs.append(_signature(s, factors, shifts).tobytes())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_shingles": n, "set_key": keys, "sig": sigs})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(sign, "doc_id long, n_shingles long, set_key binary, sig binary")


def _keys_of(sigs: np.ndarray, plan: NearDup) -> np.ndarray:
    """The keys of signatures (rows): one for each place, over the other places of its chunk."""
    starts = plan.borders()
    chunk_of = np.repeat(np.arange(plan.chunks), np.diff([*starts, plan.hashes]))
    place = _mix(np.arange(plan.hashes, dtype=np.uint64) + np.uint64(1 << 40))
    each = _mix((sigs.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + place)
    sums = np.add.reduceat(each, starts, axis=1)
    return _mix(sums[:, chunk_of] - each + place).view(np.int64)


def _unpacked(column: pa.Array, plan: NearDup) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, plan.hashes)


def _chunk_keys(nodes: DataFrame, plan: NearDup) -> DataFrame:
    """key, node: a node under each chunk with each one of its places left out."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                keys = _keys_of(_unpacked(batch.column("sig"), plan), plan)
                node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False).astype(np.int64), plan.hashes)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node)], names=["key", "node"])

    return nodes.select("node", "sig").mapInArrow(file, "key long, node long")


def _shared(keys: DataFrame) -> DataFrame:
    """key, node, center for keys with two different nodes or more; the center is the least.

    Least and greatest nodes are told in the map tasks already, so a key that very
    many nodes have is no burden there; in the merge join back such a key has one
    row on one side and is split on the other.
    """
    keys = staged(keys, "keys")
    centers = keys.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last")).filter("center < last")
    return keys.join(centers.select("key", "center").hint("merge"), "key").select("key", "node", "center")


def _near(pairs: DataFrame, nodes: DataFrame, plan: NearDup) -> DataFrame:
    """Of pairs (a, b) those whose signatures differ in ``reach`` places at most and whose set sizes allow a link."""
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n").alias(f"n_{c}"))
    joined = pairs.join(of("a"), "a").join(of("b"), "b")
    joined = joined.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * plan.similarity)
    names = [c for c in joined.columns if not c.startswith(("sig_", "n_"))]
    schema = joined.select(*names, F.lit(0).alias("distance")).schema

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (_unpacked(batch.column(f"sig_{c}"), plan) for c in "ab")
            distance = (a != b).sum(axis=1)
            ok = np.flatnonzero(distance <= plan.reach)
            kept = batch.select(names).take(pa.array(ok))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(distance[ok], pa.int32())], names=[*names, "distance"])

    return joined.mapInArrow(compare, schema)


def _confirmed(pairs: DataFrame, docs: DataFrame, plan: NearDup) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity.

    Texts meet their pairs by id; each b's set goes to its a, where a's set comes
    first and the others stream past it. An a with very many b is dealt over
    several groups, each with a's set.
    """
    spark = pairs.sparkSession
    pairs = pairs.select("a", "b").distinct()
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(plan.block)).cast("int").alias("parts"))
    members = pairs.join(counts, "a").select(F.col("b").alias("node"), F.col("a").alias("center"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"))
    heads = counts.select(F.col("a").alias("node"), F.col("a").alias("center"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    wanted = staged(members.union(heads), "wanted")

    # one text for each (doc, set of groups): groups of a document are listed, so that its set is made once
    listed = wanted.groupBy("node").agg(F.collect_list(F.struct("center", "part", "role")).alias("at"))
    # both sides grow with the documents, so they are merged at every size
    texts = docs.select(F.col("doc_id").alias("node"), "text").hint("merge").join(listed, "node")

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(plan.words)
        for frame in frames:
            for node, text, at in zip(frame["node"], frame["text"], frame["at"], strict=True):
                s = shingler.of(text).tobytes()
                for i in range(0, len(at), 64):
                    yield pd.DataFrame([(x["center"], x["part"], x["role"], node, s) for x in at[i : i + 64]], columns=["center", "part", "role", "node", "s"])

    rows = texts.mapInPandas(sets, "center long, part int, role int, node long, s binary")
    rows = rows.repartition("center", "part").sortWithinPartitions("center", "part", "role", "node")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads_of = None, []
        for batch in batches:
            found = []
            for center, part, role, node, s in zip(*(batch.column(c).to_pylist() for c in ("center", "part", "role", "node", "s")), strict=True):
                if (center, part) != now:
                    now, heads_of = (center, part), []
                own = np.frombuffer(s, np.uint64)
                if role == 0:
                    heads_of.append(own)
                    continue
                for other in heads_of:
                    both = int((other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own).sum()) if len(other) else 0
                    if 100 * both >= plan.similarity * (len(own) + len(other) - both):
                        found.append((center, node))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(confirm, "a long, b long").distinct()


def _groups(key: np.ndarray, *more: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where runs of equal keys begin and end."""
    change = np.zeros(len(key) - 1, bool)
    for k in (key, *more):
        change |= k[1:] != k[:-1]
    edges = np.flatnonzero(np.concatenate([[True], change]))
    return zip(edges.tolist(), [*edges[1:].tolist(), len(key)], strict=True)


def _grid(component: str, main: str) -> Column:
    """Where a row with ``parts``, ``slices``, ``part`` and ``slice`` goes: (part, slice, role), role 0 to be held and 1 to stream.

    Rows outside the main component are held in one of ``parts`` blocks, in every
    slice; every row streams in its slice past every block. So each pair with a
    held row meets once, a task has about ``block`` held and 4 * ``block``
    streaming rows, and n rows with h outside the main component make about
    n * h / block * 5 / 4 rows.
    """
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    streams = F.transform(every("parts"), lambda i: F.struct(i.alias("part"), F.col("slice").alias("slice"), F.lit(1).alias("role")))
    holds = F.transform(every("slices"), lambda i: F.struct(F.col("part").alias("part"), i.alias("slice"), F.lit(0).alias("role")))
    return F.explode(F.when(F.col(component) != F.col(main), F.concat(holds, streams)).otherwise(streams)).alias("at")


def _clusters(shared: DataFrame, labels: DataFrame, plan: NearDup, nodes: DataFrame) -> DataFrame:
    """component, cluster: components with members of others near them under a common key, that is ``reach`` places away at most.

    Of each key with several components, rows outside the largest one are held
    in blocks and all rows stream past them in slices (see ``_grid``), so no task
    has all rows of a key.
    """
    tagged = staged(shared.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "tagged")
    sizes = tagged.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    blocks = lambda n, size: F.ceil(n / F.lit(size)).cast("int")
    mixed = mixed.select("key", F.col("main.component").alias("main"), blocks(F.col("n") - F.col("main.n"), plan.block).alias("parts"), blocks(F.col("n"), 4 * plan.block).alias("slices"))
    rows = tagged.join(staged(mixed, "mixed"), "key").join(nodes.select("node", "sig"), "node")
    deal = lambda n: F.pmod(F.xxhash64(F.lit(n), "node"), F.col(n)).cast("int")
    rows = rows.withColumn("part", deal("parts")).withColumn("slice", deal("slices")).select("key", "node", "component", "sig", _grid("component", "main"))
    rows = rows.select("key", "at.part", "at.slice", "at.role", "node", "component", "sig").repartition("key", "part", "slice").sortWithinPartitions("key", "part", "slice", "role", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, forest, sigs = None, Forest(), np.empty((0, plan.hashes), np.uint16)
        for batch in batches:
            if not batch.num_rows:
                continue
            key, part, cut, role, comp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "slice", "role", "component"))
            mine = _unpacked(batch.column("sig"), plan)
            found = []
            for lo, hi in _groups(key, part, cut, role):
                if (key[lo], part[lo], cut[lo]) != now:
                    now, forest, sigs = (key[lo], part[lo], cut[lo]), Forest(), np.empty((0, plan.hashes), np.uint16)
                if role[lo] == 0:
                    forest.hold(comp[lo:hi])
                    sigs = np.concatenate([sigs, mine[lo:hi]])
                    continue
                step = max(1, 20_000 // max(1, len(sigs)))
                for at in range(lo, hi, step):
                    y = slice(at, min(at + step, hi))
                    near = (sigs[None, :, :] != mine[y, None, :]).sum(axis=2) <= plan.reach
                    for i in np.flatnonzero(near.any(axis=1)):
                        found += [(int(forest.comps[x]), int(comp[at + i])) for x in forest.meet(np.flatnonzero(near[i]), int(comp[at + i]))]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    united = components(rows.mapInArrow(compare, "a long, b long"))
    return united.select(F.col("node").alias("component"), F.col("component").alias("cluster"))


def _cluster_links(clusters: DataFrame, labels: DataFrame, docs: DataFrame, plan: NearDup, nodes: DataFrame) -> DataFrame:
    """Links (a, b) that unite components within a cluster, found on the full sets.

    Members outside a cluster's largest component are held in blocks; every
    member streams past every block, in slices, so that neither a cluster with
    very many members nor one with very many components is one task.
    """
    member = nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component")).join(clusters, "component")
    member = staged(member, "members")
    sizes = member.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    about = sizes.groupBy("cluster").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n"))
    about = about.select(
        "cluster", F.col("main.component").alias("main"), F.ceil((F.col("n") - F.col("main.n")) / F.lit(plan.block)).cast("int").alias("parts"), F.ceil(F.col("n") / F.lit(4 * plan.block)).cast("int").alias("slices")
    )
    deal = lambda n: F.pmod(F.xxhash64(F.lit(n), "node"), F.col(n)).cast("int")
    wanted = member.join(about, "cluster").select("node", "component", "cluster", "main", "parts", "slices", deal("parts").alias("part"), deal("slices").alias("slice"))
    wanted = staged(wanted, "wanted")

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(plan.words)
        for frame in frames:
            yield frame.drop(columns="text").assign(s=[shingler.of(t).tobytes() for t in frame["text"]])

    # both sides grow with the documents, so they are merged at every size
    texts = docs.select(F.col("doc_id").alias("node"), "text").hint("merge").join(wanted, "node")
    columns = ["node", "component", "cluster", "main", "parts", "slices", "part", "slice"]
    found = texts.select(*columns, "text").mapInPandas(sets, "node long, component long, cluster long, main long, parts int, slices int, part int, slice int, s binary")
    rows = found.select("node", "component", "cluster", "s", _grid("component", "main"))
    rows = rows.select("cluster", "at.part", "at.slice", "at.role", "node", "component", "s").repartition("cluster", "part", "slice").sortWithinPartitions("cluster", "part", "slice", "role", "node")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, forest, ids, held = None, Forest(), np.empty(0, np.int64), []
        table: tuple | None = None  # the held sets' hashes in order, whose they are, how many each has
        for whole in batches:
            links = []
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                cluster, part, cut, role, node, comp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "part", "slice", "role", "node", "component"))
                own = [np.frombuffer(s, np.uint64) for s in batch.column("s").to_pylist()]
                for lo, hi in _groups(cluster, part, cut, role):
                    if (cluster[lo], part[lo], cut[lo]) != now:
                        now, forest, ids, held, table = (cluster[lo], part[lo], cut[lo]), Forest(), np.empty(0, np.int64), [], None
                    if role[lo] == 0:
                        forest.hold(comp[lo:hi])
                        ids = np.concatenate([ids, node[lo:hi]])
                        held += own[lo:hi]
                        table = None
                        continue
                    if table is None:
                        owner = np.repeat(np.arange(len(held)), [len(x) for x in held])
                        hashes = np.concatenate(held) if held else np.empty(0, np.uint64)
                        order = np.argsort(hashes, kind="stable")
                        table = hashes[order], owner[order], np.array([len(x) for x in held])
                    hashes, owner, n = table
                    if not len(hashes):
                        continue
                    for i in range(lo, hi):
                        first, last = np.searchsorted(hashes, own[i], "left"), np.searchsorted(hashes, own[i], "right")
                        count = last - first
                        places = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                        both = np.bincount(owner[places], minlength=len(n))
                        link = np.flatnonzero((both > 0) & (100 * both >= plan.similarity * (n + len(own[i]) - both)))
                        if len(link):
                            links += [(int(ids[x]), int(node[i])) for x in forest.meet(link, int(comp[i]))]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, plan: NearDup = NearDup(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the least id reachable over links; ``kept`` says that it is
    the row's own. Null and blank texts have no shingles and no links. Rows that
    repeat an id are one document, linked with what any of them is linked with,
    and all kept or none; the text of a row without id is linked with equal sets
    only, and without any its component is null and it is kept. An empty table
    gives an empty result. Only id and text are read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    rows = staged(signatures(docs, plan), "signatures")
    nodes = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.min("sig").alias("sig"), F.min("n_shingles").alias("n"))
    nodes = staged(nodes.select("node", "sig", "n"), "nodes")

    shared = staged(_shared(_chunk_keys(nodes, plan)), "shared")
    stars = shared.filter("node <> center").groupBy(F.col("center").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("keys"))
    near = staged(_near(stars, nodes, plan), "near")
    best = near.groupBy("b").agg(F.min(F.struct("distance", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    best = staged(best, "best")
    links = staged(_confirmed(best, docs, plan), "links")
    labels = components(links)

    clusters = _clusters(shared, labels, plan, nodes)
    if not clusters.isEmpty():
        links = links.union(staged(_cluster_links(clusters, labels, docs, plan, nodes), "more-links"))
        labels = components(links)

    with_set = keyed_min(rows.filter("n_shingles > 0").select("doc_id", "n_shingles", "set_key"), "set_key", "doc_id", "node")
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("node"))
    salts = n_salts(docs.sparkSession)
    every = with_set.select("doc_id", "n_shingles", "node").union(alone).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    # a node that many rows share is looked up once for each of its salts
    lookup = every.select("node", "salt").distinct().join(labels, "node", "left").withColumn("component_id", F.coalesce("component", "node")).select(F.coalesce("node", F.lit(0)).alias("k"), F.col("node").isNull().alias("none"), "salt", "component_id")
    return (
        every.select("doc_id", "n_shingles", "salt", F.coalesce("node", F.lit(0)).alias("k"), F.col("node").isNull().alias("none"))
        .join(lookup, ["k", "none", "salt"])
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )
