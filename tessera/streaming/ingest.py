"""Structured Streaming forms of the event measures: windowed latency with late data, and deduplicated ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_latency(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and mean value of each event type by time window; later events than the watermark are left out."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


def first_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events without repeats of an id within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Processes all there is to read, then stops; a rerun goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
