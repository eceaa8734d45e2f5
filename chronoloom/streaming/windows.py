"""The series operators on streams: resampling, sessions and running counts with bounded lateness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronoloom.operators.series import resampled


def on_event_time(events: DataFrame, ts: str) -> DataFrame:
    """``events`` with ``ts`` as a timestamp of the session's zone, the type that watermarks need."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")) if events.schema[ts].dataType.typeName() == "timestamp_ntz" else events


def resampled_stream(events: DataFrame, ts: str, every: str, late: str, by: Sequence[str], **aggs: Column) -> DataFrame:
    """The batch operator behind a watermark: state is kept for windows younger than ``late``."""
    return resampled(on_event_time(events, ts).withWatermark(ts, late), ts, every, by, **aggs)


def sessions(events: DataFrame, ts: str, gap: str, by: Sequence[str], late: str | None = None, **aggs: Column) -> DataFrame:
    """Aggregates over runs of events without a pause of ``gap``; on a stream behind a watermark."""
    rows = on_event_time(events, ts).withWatermark(ts, late) if late and events.isStreaming else events
    w = F.session_window(ts, gap)
    return rows.groupBy(*by, w.alias("_w")).agg(F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in aggs.items()]).select(*by, F.col("_w.start").alias("started"), F.col("_w.end").alias("ended"), "n", *aggs)


def deduplicated(events: DataFrame, key: Sequence[str], ts: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return on_event_time(events, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(list(key))


def parquet_stream(spark: SparkSession, path: str, pattern: str | None = None, files_per_trigger: int = 8) -> DataFrame:
    """A directory of Parquet files as a stream, with the schema of what is there now."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
        return reader.schema(spark.read.option("pathGlobFilter", pattern).parquet(path).schema).parquet(path)
    return reader.schema(spark.read.parquet(path).schema).parquet(path)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what is available as Parquet, exactly once, and stops; run again it takes up where it stopped."""
    q = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").start(path)
    q.awaitTermination()
    return q
