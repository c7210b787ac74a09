"""Structured Streaming: notes and evaluations as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def timings(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and means by event type and window; works on batches and streams."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    got = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean_value")
    )
    return got.select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


def latest_evaluations(evals: DataFrame, late: str = "1 day") -> DataFrame:
    """One evaluation per trial and criterion of a stream, duplicates within the watermark dropped."""
    return evals.withWatermark("ts", late).dropDuplicatesWithinWatermark(["trial", "criterion"])


def follow(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Parse JSON evaluations from a folder and append them as Parquet, once each."""
    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
