"""Structured Streaming: append new responses once per key, and keep per-set token statistics as they come."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from polyvox.functions.text import n_bytes, ws_words


def once_per_key(stream: DataFrame, keys: Sequence[str], time: str, late: str) -> DataFrame:
    """Each key once; keys are remembered as long as rows may be late."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def windowed_lengths(stream: DataFrame, time: str, late: str, window: str) -> DataFrame:
    """Per time window and set: responses, tokens and bytes, final once the watermark has passed."""
    rows = stream.withWatermark(time, late)
    return rows.groupBy(F.window(time, window), "set_id").agg(
        F.count("*").alias("n"), F.sum(F.size(ws_words(F.col("response")))).alias("tokens"), F.sum(n_bytes(F.col("response"))).alias("bytes")
    )


def drain(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there now to Parquet and stop; run again later, it goes on where it stopped."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
