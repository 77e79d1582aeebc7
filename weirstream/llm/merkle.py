"""Merkle manifests of datasets (operator 13).

Leaves are numbered within their group; a tree of arity ``ARITY`` over each group
ends in a subroot, and one more tree over the subroots in the root. Trees are built
by events: a node that is finished goes to its parent, which holds the digests of its
children by their index until it has as many as its place and the number of leaves
say, and then is an event itself. A task takes this as far as the nodes that it has
allow. What is left, the frontier, is dealt anew by ancestors farther up, until only
roots are left. On the way every child gets a link to its parent with the siblings'
digests; followed back from the root, the links give the proofs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, staged

ARITY = 2
#: Levels of a tree that one task builds from the nodes of one ancestor: at most ARITY ** LEVELS nodes.
LEVELS = 10


def field(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def digest(parts) -> str:
    """Lowercase hexadecimal SHA-256 of digests as text, one after another."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def numbered(rows: DataFrame, group: str, order: list[str], at: str, size: str) -> DataFrame:
    """``rows`` written with ``at``, their number within ``group`` by ``order`` (nulls first), and ``size``, that of the group's rows.

    Rows are range-partitioned and numbered within a partition; what is added
    up between partitions is a number for each group and partition. Rows that
    are equal in group and order keep the places that they happened to have.
    """
    part, inner, tie, n = fresh(rows, "part", "inner", "tie", "n")
    keys = [F.col(c).asc_nulls_first() for c in [group, *order]]
    dealt = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys, F.col(tie)).sortWithinPartitions(*keys, F.col(tie))
    columns = [c for c in dealt.columns if c != tie]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, upto = object(), 0
        for batch in batches:
            counts = []
            for g in batch.column(group).to_pylist():
                last, upto = (g, 1) if g != last else (last, upto + 1)
                counts.append(upto - 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(counts, pa.int64())], names=[*columns, inner])

    schema = dealt.drop(tie).withColumn(inner, F.lit(0).cast("long")).schema
    counted = staged(dealt.mapInArrow(count, schema).withColumn(part, F.spark_partition_id()), "numbered")
    parts = counted.groupBy(group, part).agg(F.count(F.lit(1)).alias(n))
    whole = Window.partitionBy(group)
    offsets = parts.select(
        F.col(group).alias(tie), F.col(part).alias(f"{part}_"), F.sum(n).over(whole).alias(size), (F.sum(n).over(whole.orderBy(part).rowsBetween(Window.unboundedPreceding, 0)) - F.col(n)).alias(f"{n}_")
    )
    found = counted.join(offsets, counted[group].eqNullSafe(offsets[tie]) & (counted[part] == offsets[f"{part}_"]))
    return found.select(*rows.columns, (F.col(inner) + F.col(f"{n}_")).alias(at), F.col(size))


class Parents:
    """Parents that lack children, of any number of trees, and the links of those that don't."""

    def __init__(self, ceiling: int, keep_links: bool = False):
        self.ceiling = ceiling
        self.waiting: dict[tuple[str, int, int], dict[int, str]] = {}
        self.links: dict[tuple[str, int, int], tuple[int, list[str]]] | None = {} if keep_links else None
        self.sizes: dict[int, list[int]] = {}

    def _sizes(self, leaves: int) -> list[int]:
        """Numbers of nodes by level, the last is 1."""
        if leaves not in self.sizes:
            if len(self.sizes) > 10_000:
                self.sizes.clear()
            found = [leaves]
            while found[-1] > 1:
                found.append(-(-found[-1] // ARITY))
            self.sizes[leaves] = found
        return self.sizes[leaves]

    def add(self, tree: str, level: int, index: int, value: str, leaves: int) -> tuple[int, int, str] | None:
        """A finished node. Gives the node (level, index, digest) that it finishes at the ceiling or as a root, if any."""
        sizes = self._sizes(leaves)
        top = min(self.ceiling, len(sizes) - 1)
        while level < top:
            above = index // ARITY
            children = self.waiting.setdefault((tree, level + 1, above), {})
            children[index] = value
            if len(children) < min(ARITY, sizes[level] - above * ARITY):
                return None
            del self.waiting[tree, level + 1, above]
            run = sorted(children.items())
            if self.links is not None:
                for place, (child, _) in enumerate(run):
                    self.links[tree, level, child] = (place, [d for i, d in run if i != child])
            level, index, value = level + 1, above, digest(d for _, d in run)
        return level, index, value

    def left(self) -> Iterator[tuple[str, int, int, str]]:
        """The children that wait."""
        for (tree, level, _), children in self.waiting.items():
            for index, value in children.items():
                yield tree, level - 1, index, value


def _frontier_table(rows: list[tuple[str, int, int, str, int]]) -> dict[str, list]:
    return dict(zip(("g", "level", "index", "value", "leaves"), map(list, zip(*rows, strict=True)) if rows else ([], [], [], [], []), strict=True))


_NODES = "g string, level int, index long, value string, leaves long"
_ARROW_NODES = pa.schema([("g", pa.string()), ("level", pa.int32()), ("index", pa.int64()), ("value", pa.string()), ("leaves", pa.int64())])
_PROOF = "array<struct<place: int, siblings: array<string>>>"
_ARROW_PROOF = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))]))


def _rise(ceiling: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Nodes in any order to the frontier that they leave below ``ceiling``."""

    def rise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parents, leaves_of = Parents(ceiling), {}
        for batch in batches:
            out = []
            for g, level, index, value, leaves in zip(*(batch.column(c).to_pylist() for c in _ARROW_NODES.names), strict=True):
                leaves_of[g] = leaves
                if done := parents.add(g, level, index, value, leaves):
                    out.append((g, *done, leaves))
            if len(parents.waiting) > 100_000:  # of very many small trees; what is left goes on as it is
                out += [(*x, leaves_of[x[0]]) for x in parents.left()]
                parents, leaves_of = Parents(ceiling), {}
            yield pa.RecordBatch.from_pydict(_frontier_table(out), schema=_ARROW_NODES)
        yield pa.RecordBatch.from_pydict(_frontier_table([(*x, leaves_of[x[0]]) for x in parents.left()]), schema=_ARROW_NODES)

    return rise


def _ancestor(ceiling: int) -> Column:
    """The index that a node's ancestor has on the level ``ceiling``."""
    return F.expr(f"index div cast(pow({ARITY}, {ceiling} - level) as bigint)")


def _fall(ceiling: int, floor: int | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Nodes below one ancestor, and the ancestor's proof: the proofs of the nodes on level ``floor``, or of all rows (leaves)."""

    def fall(nodes: pa.Table, above: pa.Table) -> pa.Table:
        parents = Parents(ceiling, keep_links=True)
        columns = [nodes.column(c).to_pylist() for c in _ARROW_NODES.names]
        top = [parents.add(*node) for node in zip(*columns, strict=True)][-1]
        g, leaves = columns[0][0], columns[4][0]
        proofs = {(g, *top[:2]): above.column("proof")[0].as_py()}

        def proof(level: int, index: int) -> list[dict]:
            if (g, level, index) not in proofs:
                place, siblings = parents.links[g, level, index]
                proofs[g, level, index] = [{"place": place, "siblings": siblings}, *proof(level + 1, index // ARITY)]
            return proofs[g, level, index]

        if floor is None:
            out = nodes.drop_columns(list(_ARROW_NODES.names) + ["block"])
            wanted = [(0, i) for i in columns[2]]
        else:
            level = min(floor, len(parents._sizes(leaves)) - 1)
            found = {i for _, at, i in parents.links if at == level} | {i for at, i in zip(*columns[1:3], strict=True) if at == level} | ({top[1]} if top[0] == level else set())
            wanted = [(level, i) for i in sorted(found)]
            out = pa.table({"g": [g] * len(wanted), "index": pa.array([i for _, i in wanted], pa.int64())})
        out = out.append_column("proof", pa.array([proof(*x) for x in wanted], _ARROW_PROOF))
        for c in ("subroot", "root"):
            out = out.append_column(c, pa.array(above.column(c).to_pylist()[:1] * len(wanted), pa.string()))
        return out

    return fall


def _frontiers(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The nodes, and the frontier after each round; the last is one root a tree. The first round takes the nodes where they are."""
    found = [nodes]
    while len(found) < 3 or ARITY ** (LEVELS * (len(found) - 1)) < most:
        ceiling, rising = LEVELS * len(found), found[-1].select(*_ARROW_NODES.names)
        if len(found) > 1:
            rising = rising.withColumn("block", _ancestor(ceiling)).repartition("g", "block").drop("block")
        found.append(staged(rising.mapInArrow(_rise(ceiling), _NODES), "frontier"))
    return found


def _proved(frontiers: list[DataFrame], proofs: DataFrame) -> DataFrame:
    """The leaves (first of ``frontiers``) with proof, subroot and root; ``proofs`` are those of the roots: g, index (0), proof, subroot, root."""
    for r in range(len(frontiers) - 2, -1, -1):
        nodes = frontiers[r].withColumn("block", _ancestor(LEVELS * (r + 1)))
        if r:
            nodes, schema = nodes.select(*_ARROW_NODES.names, "block"), f"g string, index long, proof {_PROOF}, subroot string, root string"
        else:
            own = nodes.drop(*_ARROW_NODES.names, "block").schema
            schema = T.StructType([*own.fields, *T.StructType.fromDDL(f"proof {_PROOF}, subroot string, root string").fields])
        below = nodes.groupBy("g", "block").cogroup(proofs.withColumnRenamed("index", "block").groupBy("g", "block"))
        proofs = below.applyInArrow(_fall(LEVELS * (r + 1), LEVELS * r or None), schema)
        if r:
            proofs = staged(proofs, "proofs")
    return proofs


def _nodes(rows: DataFrame, group: str, order: list[str], value: str) -> tuple[DataFrame, int]:
    """``rows`` as leaves of a tree for each group, and the greatest number of leaves."""
    dealt = numbered(rows, group, order, "index", "leaves")
    g = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    dealt = staged(dealt.withColumn("g", g).withColumn("level", F.lit(0)).withColumn("value", F.col(value)).drop(group), "leaves")
    return dealt, dealt.agg(F.max("leaves")).first()[0] or 0


def manifest(docs: DataFrame, leaf: Column, id_col: str = "doc_id", group: str = "lang", claimed: Column | None = None) -> DataFrame:
    """A row for each row of ``docs``: ``id_col``, leaf, claimed, proof, subroot, root.

    ``leaf`` is the digest of a row (see ``leaf_of``). Of each ``group`` (a
    string; null is a group) the leaves ascend by id, nulls first, rows with the
    same id by leaf; the groups' subroots ascend by group, null first, in the
    order of UTF-8 bytes. ``proof``: for each level from the leaf to the root, the
    node's ``place`` among its parent's children and its ``siblings`` from left to
    right. ``claimed`` is the digest of what is said to be the row; null, or if
    not given, it is the leaf. Other columns are not read. No rows give no rows.

    Equal rows are leaves of their own, with proofs of their own. What a task
    holds are the nodes below one ancestor, ARITY ** LEVELS at most; a group may
    hold all rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(group).cast("string").alias("group"), leaf.alias("leaf"), (claimed if claimed is not None else leaf).alias("claimed"))
    rows = rows.withColumn("claimed", F.coalesce("claimed", "leaf"))
    leaves, most = _nodes(rows, "group", ["id", "leaf"], "leaf")
    trees = _frontiers(leaves, most)
    subroots = trees[-1].select(F.lit("").alias("all"), F.col("g").alias("tree"), F.col("value").alias("subroot"))
    tops, n_trees = _nodes(subroots, "all", ["tree"], "subroot")
    above = _frontiers(tops, n_trees)
    top = above[-1].select("g", F.lit(0).cast("long").alias("index"), F.array().cast(_PROOF).alias("proof"), F.lit("").alias("subroot"), F.col("value").alias("root"))
    # a subroot's proof starts those of its tree
    starts = _proved([above[0].withColumnRenamed("subroot", "own"), *above[1:]], top)
    starts = staged(starts.select(F.col("tree").alias("g"), F.lit(0).cast("long").alias("index"), "proof", F.col("own").alias("subroot"), "root"), "starts")
    return _proved(trees, starts).select(F.col("id").alias(id_col), "leaf", "claimed", "proof", "subroot", "root")


def folded(value: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    step = lambda own, x: F.sha2(F.concat(
        F.array_join(F.slice(x["siblings"], F.lit(1), x["place"]), ""), own, F.array_join(F.slice(x["siblings"], x["place"] + 1, F.size(x["siblings"])), "")
    ), 256)
    return F.aggregate(proof, value, step)


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, level by level, from left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda x: x["siblings"])), ""), 256)
