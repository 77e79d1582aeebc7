"""Helpers the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's pattern for one word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only where the session names none (local tests) a temporary folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="weirstream-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage: what follows doesn't compute ``df`` again, also when
    executors are lost. The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_at_end(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when the driver ends."""
    if not _staged:
        atexit.register(_drop_staged)
    _staged.append((spark, path))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path in whatever store it lies."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_staged() -> None:
    for spark, path in _staged:
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended before
            return


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for temporary columns: ``names``, with underscores added until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns that begin with two underscores called otherwise, and their names now and before.

    The operators call temporary columns so; ``withColumnsRenamed`` by the second result puts the names back.
    """
    private = [c for c in df.columns if c.startswith("__")]
    names = fresh(df, *[f"column{i}" for i in range(len(private))])
    return df.withColumnsRenamed(dict(zip(private, names, strict=True))), dict(zip(names, private, strict=True))


def n_salts(spark: SparkSession) -> int:
    """Into how many parts a hot key is dealt: as many as shuffles have partitions."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def keyed_min(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Add ``out``: the least ``value`` of all rows with the same ``key``.

    A hot key is dealt over many tasks: minima per (key, salt) first, then per
    key, and joined back on (key, salt), so no task sees all rows of a key.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(n_salts(df.sparkSession))).cast("int"))
    parts = salted.groupBy(key, "_salt").agg(F.min(value).alias("_m"))
    whole = parts.groupBy(key).agg(F.min("_m").alias(out))
    labels = parts.select(key, "_salt").join(whole, key)
    return salted.join(labels, [key, "_salt"], "left").drop("_salt")


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
