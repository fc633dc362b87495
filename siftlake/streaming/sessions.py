"""Session dashboards over a stream of events (T01): the batch measures of `operators.runs`, kept up by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of events as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def running_stats(events: DataFrame) -> DataFrame:
    """Count, mean and errors of every session over all its events so far (complete mode)."""
    return events.groupBy("session").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.count_if(F.col("kind") == "error").alias("errors"))


def windowed_stats(events: DataFrame, *, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts by window and kind; events later than the watermark are left out (append mode). Spark's own, beside the reference's measures."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def to_table(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream to Parquet exactly once and stops when what is there is read; a restart resumes from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
