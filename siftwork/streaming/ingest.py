"""Streaming form of the incremental ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from siftwork.sources.scan import new_rows


def read_drops(spark: SparkSession, path: str, schema: T.StructType,
               files_per_batch: int = 1000) -> DataFrame:
    """Parquet files landing in a folder, with the arrival time as event time."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
        .withColumn("arrived", F.current_timestamp()))


def ingest_stream(drops: DataFrame, target: str, checkpoint: str,
                  watermark: str = "1 hour", **trigger) -> StreamingQuery:
    """Append rows with unseen file names to ``target``.

    Repeats inside the watermark are dropped by state; older ones, and batches
    replayed after a failure, by the anti-join with what is stored."""
    deduped = drops.withWatermark("arrived", watermark).dropDuplicatesWithinWatermark(["filename"])

    def append(batch: DataFrame, _epoch: int) -> None:
        spark = batch.sparkSession
        stored = spark.read.schema(batch.schema).option("ignoreMissingFiles", True).parquet(target)
        new_rows(batch, stored).write.mode("append").parquet(target)

    _touch(drops.sparkSession, target)
    return (
        deduped.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start())


def _touch(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
