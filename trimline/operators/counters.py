"""Queries over self-metrics: a long table ``metric, <labels>, ts, seq, value``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trimline.functions.clock import epoch_us, floor_us, like_input

# Names of the metrics kept from a scrape, without their application prefix.
KEPT_METRICS = (
    "escalation_queue_depth",
    "escalations_dispatched_total",
    "escalation_degradations_total",
    "cycle_skipped_total",
)


def keep_metrics(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    return metrics.filter(F.col("metric").isin(*names))


def latest_gauge(metrics: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Last value per metric and labels by ``(ts, seq)``."""
    return metrics.groupBy("metric", *labels).agg(
        F.max_by("value", F.struct("ts", "seq")).alias("value")
    )


def _delta(before: Column, value: Column) -> Column:
    """Growth of a counter between two samples; a lower value means it restarted from 0."""
    return F.when(value < before, value).otherwise(value - before)


def counter_increase(
    metrics: DataFrame, labels: Sequence[str], window_seconds: int, chunk_seconds: int = 60
) -> DataFrame:
    """Reset-aware increase per series and window.

    The growth between two samples belongs to the window of the later one. A counter series may
    hold a large part of all rows, so it is cut into time chunks: deltas within a chunk are
    computed per ``(series, chunk)``, and only the first and last value of every chunk are
    ordered along the whole series.
    """
    if window_seconds % chunk_seconds:
        raise ValueError("chunk_seconds must divide window_seconds")
    series = ["metric", *labels]
    rows = metrics.select(
        *series,
        epoch_us(F.col("ts")).alias("ts_us"),
        "seq",
        "value",
        floor_us(epoch_us(F.col("ts")), chunk_seconds).alias("chunk_us"),
    )
    in_chunk = Window.partitionBy(*series, "chunk_us").orderBy("ts_us", "seq")
    order = F.struct("ts_us", "seq")
    chunks = (
        rows.withColumn("delta", _delta(F.lag("value").over(in_chunk), F.col("value")))
        .groupBy(*series, "chunk_us")
        .agg(
            F.coalesce(F.sum("delta"), F.lit(0.0)).alias("inner"),
            F.min_by("value", order).alias("first_value"),
            F.max_by("value", order).alias("last_value"),
        )
    )
    along = Window.partitionBy(*series).orderBy("chunk_us")
    bridged = chunks.withColumn(
        "bridge",
        F.coalesce(_delta(F.lag("last_value").over(along), F.col("first_value")), F.lit(0.0)),
    )
    back = like_input(metrics)
    return (
        bridged.groupBy(*series, floor_us(F.col("chunk_us"), window_seconds).alias("window_us"))
        .agg((F.sum("inner") + F.sum("bridge")).alias("increase"))
        .select(*series, back(F.col("window_us")).alias("window_start"), "increase")
    )


def counter_rate(
    metrics: DataFrame, labels: Sequence[str], window_seconds: int = 300, chunk_seconds: int = 60
) -> DataFrame:
    """Increase per second in each window; edges are not extrapolated."""
    return (
        counter_increase(metrics, labels, window_seconds, chunk_seconds)
        .withColumn("rate", F.col("increase") / float(window_seconds))
        .drop("increase")
    )


def total_by_labels(
    metrics: DataFrame, labels: Sequence[str], by: Sequence[str], window_seconds: int = 3600
) -> DataFrame:
    """Increase summed over all series that share the labels ``by``."""
    return (
        counter_increase(metrics, labels, window_seconds)
        .groupBy("metric", *by)
        .agg(F.sum("increase").alias("increase"))
    )


