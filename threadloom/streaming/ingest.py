"""Structured Streaming counterparts: incremental file ingest and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources.ndjson import parsed


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> None:
    """Parse new NDJSON files of ``folder`` into Parquet and stop; the checkpoint is the ledger of files done.

    Restarting reads only files that came since; a file is taken once even when the job dies in between.
    """
    lines = spark.readStream.schema("value string").text(folder).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("_source_file"))
    parsed(lines).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed(comments: DataFrame, late: str = "2 days", every: str = "1 day") -> DataFrame:
    """Comments per window and subreddit; rows later than ``late`` behind the newest are left out of a stream, as a batch counts all."""
    timed = comments.withColumn("ts", F.timestamp_seconds("created_utc"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", every).alias("w"), "subreddit").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "subreddit", "n")
