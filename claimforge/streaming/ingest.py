"""Streams: incremental ingest of packages, and windowed counts of events with late data. Extensions beyond batch runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from claimforge.sources.packages import MANIFEST, snake


def manifest_stream(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    return snake(spark.readStream.schema(MANIFEST).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger).json(f"{root}/documents/*/manifest.json"))


def ingest(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Give each micro-batch to `handle(batch, batch_id)`, once for each batch id; a batch's last row of a package counts."""

    def one(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("document_package_id").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "document_package_id"]), F.struct("source_sha256", "source_file_name")).alias("m"))
        handle(last.select("document_package_id", "m.*"), batch_id)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value by type and window of event time; rows later than the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
