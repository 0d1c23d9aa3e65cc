"""Resumable appends and, as an extension, event streams with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.sources.sinks import append_new


def resume_into(stream: DataFrame, path: str, key: list[str], checkpoint: str) -> StreamingQuery:
    """Rows of a stream appended once a key: each micro-batch is an anti-join against what the table has, so a replayed batch adds nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_within(stream: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """Extension: the first row of a key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def windowed(stream: DataFrame, time: str, late: str, width: str, by: str, value: str) -> DataFrame:
    """Extension: counts and sums by tumbling window."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
