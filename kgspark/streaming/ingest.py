"""Incremental ingest with Structured Streaming; every batch is idempotent by its keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.storage import shared_dir


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], name: str) -> None:
    """Hand all data that is there now to ``each(batch, number)``, then stop. Progress is kept under ``name`` in the shared folder."""
    where = f"{shared_dir(stream.sparkSession)}/streams/{name}"
    stream.writeStream.foreachBatch(each).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(spark: SparkSession, folder: str, pattern: str, name: str, width: str = "1 day") -> DataFrame:
    """Events counted by type and time window as they arrive; partial counts a batch, added up when read.

    A batch that is run again overwrites its own part, so nothing counts twice.
    """
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    target = f"{shared_dir(spark)}/stream-{name}"

    def each(batch: DataFrame, number: int) -> None:
        part = batch.groupBy(F.window(F.col("ts").cast("timestamp"), width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        part.select(F.col("w.start").alias("window_start"), "event_type", "n", "total").write.mode("overwrite").parquet(f"{target}/batch={number}")

    run_available(events, each, name)
    return spark.read.parquet(target).groupBy("window_start", "event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def ingest_documents(stream: DataFrame, build: Callable[[DataFrame], None], name: str) -> None:
    """Documents to a graph build a batch; builds skip stored chunks, so a repeated batch changes nothing."""
    run_available(stream, lambda batch, _: build(batch), name)


def deduplicated(stream: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """Rows whose key did not come within ``delay`` before; state is bounded by the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
