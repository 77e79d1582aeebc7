"""Exact dedup by a persistent digest index (operator 7, native).

The index is a Parquet table, bucketed and sorted by the SHA-256 of a text, with
one row per known text. A batch is digested, reduced to its distinct digests,
anti-joined against the index (a merge join that reads the index by its buckets,
without moving it) and what is new is appended. What the index then holds decides
which rows stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import aside, drop_at_end, n_salts, shared_dir, staged

_INDEX_SCHEMA = "digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING"


class DigestIndex:
    """A table of digests, created on first use and kept in ``path``.

    A session that finds files at ``path`` takes them as the index of earlier
    runs. ``buckets`` must stay what it was when the index was made.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark).rstrip('/')}/digest-index-{uuid.uuid4().hex}"
        if not path:
            drop_at_end(spark, self.path)
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} ({_INDEX_SCHEMA}) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def lacking(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index lacks. Only the groups are shuffled, into the index's buckets."""
        return groups.hint("merge").join(self.read().select("digest"), "digest", "left_anti")

    def append_new(self, groups: DataFrame, batch: str) -> None:
        """Append the groups whose digest the index lacks, as those of ``batch``."""
        fresh = staged(self.lacking(groups), "fresh")
        fresh.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch")).repartition(self.buckets, "digest").write.insertInto(self.table)

    def drop(self) -> None:
        """Forget the table in this session; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def with_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``digest``: SHA-256 of the text in UTF-8; null counts as empty."""
    return docs.withColumn("digest", digest_of(F.col(text)))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, digest, keep_id, group_size, kept, seen_before.

    Of equal texts the row with the largest id stays. Rows that repeat id and
    text as well count in ``group_size``, and exactly one of them stays. A null
    id is less than any other. Texts that ``index`` knew before are not kept
    (``seen_before``); their ``keep_id`` is the one the index holds. No other
    column is read, so extra columns and their names don't matter. An empty
    table gives an empty result.

    A text that a third of all rows share is dealt over many tasks: rows are
    grouped by (digest, salt of the id) first.
    """
    spark = docs.sparkSession
    own = index is None
    index = index or DigestIndex(spark)
    batch = uuid.uuid4().hex
    salts = n_salts(spark)
    rows = with_digest(docs.select(F.col(id_col).alias("id"), F.col(text).alias("_t")), "_t").select(
        "id", "digest", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt")
    )
    part = Window.partitionBy("digest", "salt")
    rows = staged(
        rows.withColumn("rn", F.row_number().over(part.orderBy(F.col("id").desc_nulls_last()))).withColumn("n", F.count(F.lit(1)).over(part)),
        "digests",
    )
    parts = rows.filter("rn = 1").select("digest", "salt", "id", "n")
    groups = parts.groupBy("digest").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    groups = staged(groups, "groups")
    index.append_new(groups, batch)
    # every digest of the batch is in the index now; its row says which batch brought it and which id stays
    held = index.read().select("digest", F.col("keep_id"), (F.col("batch") != batch).alias("seen_before"))
    group_of = groups.select("digest", "group_size").hint("merge").join(held, "digest")
    labels = staged(parts.select("digest", "salt").join(group_of, "digest"), "labels")
    if own:
        index.drop()
    return rows.join(labels, ["digest", "salt"]).select(
        F.col("id").alias(id_col),
        "digest",
        "keep_id",
        "group_size",
        (~F.col("seen_before") & (F.col("rn") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "seen_before",
    )


def drop_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """``docs`` without its exact copies, all columns kept.

    Repeated rows (same id, same text) leave one row; which of them is not told
    apart, but for other columns the least row in their order stays.
    """
    docs, names = aside(docs)
    key = [F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__no_id")]
    kept = exact_dedup(docs, index).filter("kept").select(*key, F.col("digest").alias("__d"))
    rank = Window.partitionBy("__id", "__no_id", "__d").orderBy(*[F.col(c) for c, kind in docs.dtypes if c not in ("doc_id", "text") and not kind.startswith("map")] or [F.lit(1)])
    return (
        docs.select(*docs.columns, *key, digest_of(F.col("text")).alias("__d"))
        .join(kept, ["__id", "__no_id", "__d"], "left_semi")
        .withColumn("__rn", F.row_number().over(rank))
        .filter("__rn = 1")
        .select(*docs.columns)
        .withColumnsRenamed(names)
    )
