"""Folders for what queries write on the way, and streams replayed from tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``); a temporary one where the master is local and none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="weirstream-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def replayed(rows: DataFrame, step, batches: int = 4) -> DataFrame:
    """Run a streaming step over ``rows`` as a file stream of some batches in the order of the second column, and read what it wrote."""
    spark = rows.sparkSession
    root = folder(spark, "stream")
    at = rows.columns[1]
    lo, hi = rows.agg(F.min(at), F.max(at)).first()
    part = F.least(F.floor((F.col(at) - lo) * batches / F.lit(max(1, (hi or 0) - (lo or 0)))), F.lit(batches - 1)).cast("int")
    rows.withColumn("_part", part).write.partitionBy("_part").parquet(f"{root}/in")
    out = None
    for i in range(batches):  # a run for each part, with as many files as its rows make; state goes on between them
        source = spark.readStream.schema(rows.schema).parquet(f"{root}/in/_part={'{' + ','.join(map(str, range(i + 1))) + '}'}")
        out = step(source)
        run = out.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out")
        run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")
