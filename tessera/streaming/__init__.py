"""Incremental ingestion of score slices, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.tables import SLICE_SCHEMA, flat_slices


def slice_stream(spark: SparkSession, path: str) -> DataFrame:
    """Score slices as files arrive, flat as the batch reader's, each (rung, round) once: the
    state is one key for each slice, not for each row."""
    nested = spark.readStream.option("multiLine", True).schema(SLICE_SCHEMA).json(path)
    return flat_slices(nested.dropDuplicates(["rung", "round"]))


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append whatever is there now, then stop; a later call goes on from here."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type in tumbling windows; later rows than ``late`` are dropped."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
