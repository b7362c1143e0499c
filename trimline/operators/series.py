"""One row per series: keys, summary, data window and latest metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trimline.functions.clock import like_input
from trimline.operators.buckets import (
    LIVE,
    PREFIXES,
    bucket_span,
    fine_level,
    merge_aggregates,
    with_mean_p50,
)
from trimline.params import Tiering
from trimline.schemas import METADATA_DEFAULTS, METADATA_TYPES, SERIES

LATEST = ("cpu_request_millis", "cpu_limit_millis", "mem_request_bytes", "mem_limit_bytes",
          "restart_count", "qos_class")


def series_keys(samples: DataFrame) -> DataFrame:
    return samples.select(*SERIES).distinct()


def series_summary(samples: DataFrame, t: Tiering) -> DataFrame:
    """Merge all retained buckets of a series, with its data window."""
    return summarise(fine_level(samples, t), t, like_input(samples))


def summarise(fine_rows: DataFrame, t: Tiering, back=F.timestamp_micros) -> DataFrame:
    """Summary per series from fine-level rows.

    The merge is associative, so no coarse roll-up is needed first; it only shows in the window
    edges. Live samples enter the window with their own times.
    """
    return merge_spans(with_span(fine_rows, t), back)


def with_span(fine_rows: DataFrame, t: Tiering) -> DataFrame:
    """Fine-level rows with the span of their retained bucket and of the data window."""
    start, end = bucket_span(t)
    live = F.col("tier") == LIVE
    rows = fine_rows.withColumns({"start_us": start, "end_us": end})
    return rows.withColumns(
        {
            "from_us": F.when(live, F.col("first_us")).otherwise(F.col("start_us")),
            "to_us": F.when(live, F.col("last_us")).otherwise(F.col("end_us")),
        }
    )


def merge_spans(rows: DataFrame, back=F.timestamp_micros) -> DataFrame:
    """Summary per series from rows of any width that carry their spans."""
    merged = rows.groupBy(*SERIES).agg(
        *merge_aggregates(),
        F.min("start_us").alias("start_us"),
        F.max("end_us").alias("end_us"),
        F.min("from_us").alias("from_us"),
        F.max("to_us").alias("to_us"),
    )
    return with_mean_p50(merged).select(
        *SERIES,
        back(F.col("start_us")).alias("window_start"),
        back(F.col("end_us")).alias("window_end"),
        F.col("n").alias("sample_count"),
        *[f"{p}_{k}" for p in PREFIXES for k in ("p50", "p95", "p99", "max")],
        ((F.col("to_us") - F.col("from_us")) * 1000).alias("data_window_ns"),
    )


def latest_metadata(samples: DataFrame) -> DataFrame:
    """Metadata of the last sample by ``(ts, seq)``.

    Requests fall back to 0 when the last sample has none. The owner is that of the last sample
    that has one.
    """
    order = F.struct("ts", "seq")
    latest = F.max_by(F.struct(*LATEST), order)
    owner = F.max_by(
        F.when(F.col("owner_kind") != "", F.struct("owner_kind", "owner_name")),
        F.when(F.col("owner_kind") != "", order),
    )
    grouped = samples.groupBy(*SERIES).agg(latest.alias("latest"), owner.alias("owner"))
    return fill_metadata(grouped.select(*SERIES, "latest.*", "owner.*"))


def fill_metadata(df: DataFrame) -> DataFrame:
    """Replace absent metadata by zero values and fix the column types."""
    return df.withColumns(
        {name: _default(F.col(name), name) for name in METADATA_DEFAULTS if name in df.columns}
    )


def _default(column: Column, name: str) -> Column:
    return F.coalesce(column, F.lit(METADATA_DEFAULTS[name])).cast(METADATA_TYPES[name])


def series_snapshot(summary: DataFrame, metadata: DataFrame) -> DataFrame:
    """Summary, window and metadata of a series in one row."""
    return summary.join(metadata, list(SERIES))
