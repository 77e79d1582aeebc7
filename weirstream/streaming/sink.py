"""Ordered output of segments with a checkpoint, as a ``foreachBatch`` sink and in batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.binary import protection, segment_decrypt, without_image_header
from ..functions.cenc import clear
from ..functions.tscipher import ts_decrypt
from ..plans.segments import committed
from ..sources import transport
from . import ordering


def transformed(pieces: DataFrame, inits: DataFrame | None = None) -> DataFrame:
    """Pieces (stream_id, is_init, data, aes_key, iv, seq) as they are written: image headers off, then common encryption, AES-128, and the packet cipher.

    With ``inits`` (stream_id, data), media pieces with a ``cenc_key`` are decrypted by what the
    stream's init segment says of its first encrypted track; streams without such a track, and init
    pieces, keep their bytes. AES-128 is undone where there is an ``aes_key``, of init pieces too. Media
    pieces with a ``ts_key`` (a column that may be missing) are deciphered by the IV in their own tables.
    """
    rows = pieces.withColumn("data", without_image_header(F.col("data")))
    if inits is not None:
        tracks = protection(inits.select(F.col("stream_id").alias("id"), "data"))
        about = tracks.groupBy(F.col("id").alias("stream_id")).agg(F.min_by(F.struct("scheme", "iv_size", "crypt", "skip", "constant_iv"), "track").alias("_how"))
        how = lambda name: F.col(f"_how.{name}")
        key = F.when(~F.col("is_init") & F.col("_how").isNotNull(), F.col("cenc_key"))
        rows = rows.join(about, "stream_id", "left").withColumn("data", clear(F.col("data"), key, *map(how, ("scheme", "iv_size", "crypt", "skip", "constant_iv")))).drop("_how")
    rows = rows.withColumn("data", F.when(F.col("aes_key").isNotNull(), segment_decrypt(F.col("data"), F.col("aes_key"), F.col("iv"), F.col("seq"))).otherwise(F.col("data")))
    if "ts_key" in rows.columns:
        key = F.when(~F.col("is_init"), F.col("ts_key"))
        rows = rows.withColumn("data", F.when(key.isNotNull(), ts_decrypt(F.when(key.isNotNull(), F.col("data")), key)).otherwise(F.col("data")))
    return rows


def placed(pieces: DataFrame) -> DataFrame:
    """Pieces (stream_id, idx, ok, data) before the first failure with ``offset``, where each begins in its stream's file."""
    from pyspark.sql import Window

    before = Window.partitionBy("stream_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return committed(pieces).withColumn("offset", F.coalesce(F.sum(F.octet_length("data")).over(before), F.lit(0)).cast("long"))


def checkpoints(written: DataFrame) -> DataFrame:
    """stream_id, next_idx, offset after what was written."""
    return written.groupBy("stream_id").agg((F.max("idx") + 1).alias("next_idx"), F.max(F.col("offset") + F.octet_length("data")).cast("long").alias("offset"))


class SegmentSink:
    """Init and media pieces of a stream of batches, kept as Parquet by batch.

    ``write`` is for ``foreachBatch``: a batch that comes again replaces what it
    wrote before, so each piece is there once. ``files`` gives the pieces in order.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, batch: DataFrame, batch_id: int) -> None:
        # by ranges, so that a stream with most of a batch's bytes is written by many tasks
        batch.repartitionByRange("stream_id", "idx").sortWithinPartitions("stream_id", "idx").write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self, spark: SparkSession, schema: str | None = None) -> DataFrame:
        """The pieces of all batches; with their ``schema`` also before the first, when there are none."""
        try:
            source = spark.read.schema(f"{schema}, batch long") if schema else spark.read
            return source.option("basePath", self.path).parquet(self.path).drop("batch")
        except AnalysisException as e:
            if schema is None or e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)


class Counters:
    """Continuity counters that run on over the batches of a stream of segments (stream, segment, data).

    ``counting`` keeps, for each stream and PID, how many packets have counted so far as state, and writes
    down where each segment's counters begin; ``read`` rewrites segments by that. A stream's batches
    must come in the order of its segments.
    """

    def __init__(self, path: str):
        self.path = path

    def counting(self, segments: DataFrame, **trigger) -> StreamingQuery:
        ordering.use_rocksdb(segments.sparkSession)
        starts = ordering.running_starts(transport.counts_of(segments))
        out = starts.writeStream.format("parquet").option("checkpointLocation", f"{self.path}/checkpoint")
        return (out.trigger(**trigger) if trigger else out).start(f"{self.path}/starts")

    def read(self, segments: DataFrame) -> DataFrame:
        kinds = dict(segments.dtypes)
        starts = segments.sparkSession.read.schema(f"stream {kinds['stream']}, pid int, segment {kinds['segment']}, before long").parquet(f"{self.path}/starts")
        return transport.rewritten(segments, starts)
