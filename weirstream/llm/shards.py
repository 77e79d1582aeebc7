"""Two-pass external shuffle into shards (operator 10).

Pass 1 scatters rows into memory-sized buckets by a seeded hash. Pass 2 shuffles
each bucket by Fisher-Yates from a generator seeded with (seed, bucket). A row's
place in the whole order is the bucket's offset plus its place in the bucket;
shards are equal slices of that order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of 0..n-1 that (seed, bucket) decide: ``numpy`` shuffles in place by Fisher-Yates."""
    order = np.arange(n)
    np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)
    return order


#: Bucket offsets are broadcast up to this many buckets (16 bytes each), else joined by a shuffle.
MAX_BROADCAST_BUCKETS = 200_000


def external_shuffle(
    docs: DataFrame, n_shards: int = 16, bucket_bytes: int = 8 << 20, seed: int = 20240601, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` int and ``slot`` long added.

    Shards have equal numbers of rows, at most one apart; slots count from 0
    without gaps in each shard. Reruns agree: the bucket is a hash of id and
    text, and a bucket is put in the order of (hash, id, text) before it is
    shuffled, so how Spark dealt the rows doesn't matter. Rows that repeat id
    and text fall into one bucket and may swap places, which can't be seen but
    in other columns. Equal texts under different ids are dealt like any other
    rows: law ``rows`` knows rows, not groups. Null ids and texts hash as such.
    Input columns named ``shard`` or ``slot`` are replaced, all others pass, however
    they are called. An empty table gives an empty result.

    ``bucket_bytes`` is the mean bucket's text; that is all one task holds, but for
    a single text, or rows that repeat id and text, of more than that.
    """
    docs, names = aside(docs.drop("shard", "slot"))
    id_col, text = ({b: a for a, b in names.items()}.get(c, c) for c in (id_col, text))
    columns = docs.columns
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 32
    h = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text))
    total = docs.agg(F.sum(size.cast("long")), F.count(F.lit(1))).first()
    n_rows = total[1]
    n_buckets = max(1, -(-(total[0] or 0) // bucket_bytes))
    light = docs.select(F.pmod(h, F.lit(n_buckets)).alias("__bucket"))
    counts = light.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("__bucket", (F.sum("__n").over(Window.orderBy("__bucket")) - F.col("__n")).alias("__offset"))
    if n_buckets <= MAX_BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    dealt = docs.withColumn("__h", h).withColumn("__bucket", F.pmod("__h", F.lit(n_buckets))).join(offsets, "__bucket").select(*columns, "__h", "__bucket", "__offset")
    base, extra = divmod(n_rows, n_shards)
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def shuffle_bucket(table: pa.Table) -> pa.Table:
        table = table.sort_by([("__h", "ascending"), (id_col, "ascending"), (text, "ascending")])
        first = {c: table.column(c)[0].as_py() for c in ("__bucket", "__offset")}
        table = table.take(pa.array(fisher_yates(table.num_rows, seed, first["__bucket"])))
        place = first["__offset"] + np.arange(table.num_rows)
        long_part = extra * (base + 1)  # the first ``extra`` shards have one row more
        shard = np.where(place < long_part, place // (base + 1), extra + (place - long_part) // max(base, 1))
        slot = place - shard * base - np.minimum(shard, extra)
        return table.select(columns).append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(slot, pa.int64()))

    return dealt.groupBy("__bucket").applyInArrow(shuffle_bucket, schema).withColumnsRenamed(names)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Shuffle ``docs`` and write a folder for each shard, files sorted by slot."""
    out = external_shuffle(docs, **options)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
