"""Triggers and replay-safe writes of micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_INTERVAL_MS = 100


def trigger_of(interval_ms: int | None) -> dict:
    """Trigger arguments: a fixed interval of at least 100 ms, or all available data once."""
    if interval_ms is None:
        return {"availableNow": True}
    return {"processingTime": f"{max(interval_ms, MIN_INTERVAL_MS)} milliseconds"}


def write_batch(df: DataFrame, path: str, batch_id: int, partitions: tuple[str, ...] = ("day",)):
    """Write one micro-batch so that writing it again replaces it."""
    (
        df.withColumn("batch_id", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions, "batch_id")
        .parquet(path)
    )
