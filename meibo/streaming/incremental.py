"""Incremental runs over arriving files: each micro-batch appends what its keys have not brought yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meibo.sources.sinks import append_new


def append_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str], transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """JSON files of ``source`` appended to a Parquet table, once per key however often they are delivered.

    Ends when all files present have been read; the checkpoint folder makes the next call go on from there.
    """
    stream = spark.readStream.schema(schema).json(source)
    if transform:
        stream = transform(stream)

    def save(batch: DataFrame, _: int) -> None:
        append_new(batch, target, keys)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, key: str, size: str, late: str) -> DataFrame:
    """Events per window and key; on a stream, rows later than ``late`` are dropped.  An extension: the batch pipeline has no event time."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    return marked.groupBy(F.window(ts, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
