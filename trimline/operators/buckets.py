"""Tiered buckets of a sample table.

A *fine-level row* is one bucket of the live, fine or coarse tier before coarse roll-up. It
carries, per metric prefix, ``_p50 _p95 _p99 _max`` and ``_wsum`` (P50 times sample count, kept
as a sum so that merging stays exact), plus ``n`` and the edges ``first_us`` / ``last_us``.
Merging rows is ``sum(_wsum)/sum(n)`` and ``max`` of the rest, so every roll-up is a plain
decomposable aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trimline.functions.clock import MICROS, as_of_range, epoch_us, floor_us, like_input
from trimline.operators.percentiles import (
    large_groups,
    small_aggregate,
    split_aggregate,
    split_by,
)
from trimline.params import EXACT, Tiering
from trimline.schemas import METRICS, SERIES

LIVE, FINE, COARSE = "live", "fine", "coarse"
PREFIXES = tuple(METRICS.values())

_BUCKET = [*SERIES, "clock_us", "tier", "bucket_us"]


def without_nulls(samples: DataFrame) -> DataFrame:
    """One rule for batches, streams and tables: a missing key part is empty, missing usage is 0."""
    return samples.withColumns(
        {
            **{k: F.coalesce(F.col(k), F.lit("")) for k in SERIES},
            **{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in METRICS},
        }
    )


def slim(samples: DataFrame, t: Tiering, keep_seconds: int | None = None) -> DataFrame:
    """Keys, epoch time and the three metrics only, cut to the retention range of a fixed clock.

    The cut is a plain range on ``ts`` so that it reaches the scan. ``keep_seconds`` narrows it.
    """
    if t.as_of is not None:
        samples = samples.filter(as_of_range(samples, t.as_of, keep_seconds or t.coarse_keep_seconds))
    # never NULL, so joins on the keys need no extra filters and equal plans can be reused
    return without_nulls(samples).select(*SERIES, epoch_us(F.col("ts")).alias("ts_us"), *METRICS)


def series_clock(rows: DataFrame) -> DataFrame:
    """Latest sample time and row count per series; map-side combined, one row per series."""
    return rows.groupBy(*SERIES).agg(
        F.max("ts_us").alias("clock_us"), F.count(F.lit(1)).alias("n_rows")
    )


def with_clock(rows: DataFrame, t: Tiering) -> tuple[DataFrame, DataFrame]:
    """``(rows of ordinary series, rows of hot series)``, each with ``clock_us``.

    Without a fixed clock the ordinary rows are hash-partitioned by series here, which all later
    per-series aggregates reuse. Hot series are few (``rows / hot_rows`` at most); AQE broadcasts their
    clocks when that list is small, and splits their rows where it is not.
    """
    keys = list(SERIES)
    # both filters use both columns, so that all uses of the statistics share one exchange
    stats = series_clock(rows).filter(F.col("clock_us").isNotNull())
    hot = stats.filter(F.col("n_rows") >= t.hot_rows).drop("n_rows")
    small = rows.join(hot, keys, "left_anti")
    large = rows.join(hot, keys)
    if t.as_of is not None:
        now = _as_of_us(t)
        return small.withColumn("clock_us", now), large.withColumn("clock_us", now)
    clocks = stats.filter(F.col("n_rows") < t.hot_rows).drop("n_rows")
    return small.join(clocks.hint("shuffle_hash"), keys), large


def _as_of_us(t: Tiering) -> Column:
    # cast by way of TIMESTAMP_NTZ: a naive datetime means UTC, whatever the driver's zone is
    return epoch_us(F.lit(t.as_of.isoformat(sep=" ")).cast("timestamp_ntz"))


def assign_tier(rows: DataFrame, t: Tiering) -> DataFrame:
    """Add ``tier`` and ``bucket_us`` (fine-level bucket start); expired samples are dropped.

    Comparisons keep boundary values in the younger tier, and expiry looks at the bucket start.
    """
    ts, clock = F.col("ts_us"), F.col("clock_us")
    fine_start = floor_us(ts, t.fine_seconds)
    live_start = clock - t.raw_seconds * MICROS
    tier = (
        F.when(ts >= live_start, LIVE)
        .when(fine_start >= clock - t.fine_keep_seconds * MICROS, FINE)
        .when(
            floor_us(fine_start, t.coarse_seconds) >= clock - t.coarse_keep_seconds * MICROS,
            COARSE,
        )
    )
    return (
        rows.withColumn("tier", tier)
        .filter(F.col("tier").isNotNull())
        .withColumn("bucket_us", F.when(F.col("tier") == LIVE, live_start).otherwise(fine_start))
    )


def fine_level(samples: DataFrame, t: Tiering) -> DataFrame:
    """All fine-level rows of all series."""
    live = F.col("tier") == LIVE
    if t.mode == EXACT:
        return _ranked(*_tiered(slim(samples, t), t), t)
    if t.as_of is None:
        small, large = _tiered(slim(samples, t), t)
        settled = small.filter(~live).unionByName(large.filter(~live))
        ranked = _ranked(small.filter(live), large.filter(live), t)
    else:
        # one scan and one map-side combined shuffle; nothing here depends on the series
        rows = slim(samples, t).withColumn("clock_us", _as_of_us(t))
        settled = assign_tier(rows, t).filter(~live)
        # the live tail is a second, narrow scan
        ranked = _ranked(*_tiered(slim(samples, t, t.raw_seconds), t), t)
    return _merged_singletons(settled).unionByName(ranked)


def _tiered(rows: DataFrame, t: Tiering) -> tuple[DataFrame, DataFrame]:
    small, large = with_clock(rows, t)
    return assign_tier(small, t), assign_tier(large, t)


def _ranked(small: DataFrame, large: DataFrame, t: Tiering) -> DataFrame:
    """Exact buckets. Buckets of hot series are grouped like any other, except huge ones."""
    edges = [F.expr("min(ts_us) AS first_us"), F.expr("max(ts_us) AS last_us")]
    rest, huge = split_by(large, large_groups(large, _BUCKET, t.hot_bucket_rows), _BUCKET)
    ranked = (
        small_aggregate(small, _BUCKET, METRICS, edges)
        .unionByName(small_aggregate(rest, _BUCKET, METRICS, edges))
        .unionByName(split_aggregate(huge, _BUCKET, METRICS, edges))
    )
    return ranked.selectExpr("*", *[f"{p}_p50 * n AS {p}_wsum" for p in PREFIXES])


def _merged_singletons(settled: DataFrame) -> DataFrame:
    """Buckets built one sample at a time: hash aggregate of count, sum and max."""
    merged = settled.groupBy(*_BUCKET).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"{p}_wsum") for c, p in METRICS.items()],
        *[F.max(c).alias(f"{p}_max") for c, p in METRICS.items()],
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
    )
    columns = {}
    for p in PREFIXES:
        columns[f"{p}_p50"] = F.col(f"{p}_wsum") / F.col("n")
        columns[f"{p}_p95"] = columns[f"{p}_p99"] = F.col(f"{p}_max")
    return merged.withColumns(columns)


def merge_aggregates(prefixes: tuple[str, ...] = PREFIXES) -> list[Column]:
    """Aggregates that merge bucket rows: ``n``, ``_wsum``, ``_p95``, ``_p99``, ``_max``."""
    return [
        F.sum("n").alias("n"),
        *[F.sum(f"{p}_wsum").alias(f"{p}_wsum") for p in prefixes],
        *[F.max(f"{p}_{k}").alias(f"{p}_{k}") for p in prefixes for k in ("p95", "p99", "max")],
    ]


def with_mean_p50(merged: DataFrame, prefixes: tuple[str, ...] = PREFIXES) -> DataFrame:
    """P50 of merged rows: sample-weighted mean, 0 for zero samples."""
    return merged.withColumns(
        {
            f"{p}_p50": F.when(F.col("n") == 0, 0.0).otherwise(F.col(f"{p}_wsum") / F.col("n"))
            for p in prefixes
        }
    )


def merge_buckets(df: DataFrame, keys: list[str], prefixes: tuple[str, ...]) -> DataFrame:
    """Merge rows with ``n`` and ``<p>_p50/_p95/_p99/_max`` columns per ``keys``."""
    weighted = df.withColumns({f"{p}_wsum": F.col(f"{p}_p50") * F.col("n") for p in prefixes})
    merged = weighted.groupBy(*keys).agg(*merge_aggregates(prefixes))
    return with_mean_p50(merged, prefixes).drop(*[f"{p}_wsum" for p in prefixes])


def bucket_span(t: Tiering) -> tuple[Column, Column]:
    """Start and end of the retained bucket of a fine-level row, coarse rows at coarse width."""
    start = F.when(
        F.col("tier") == COARSE, floor_us(F.col("bucket_us"), t.coarse_seconds)
    ).otherwise(F.col("bucket_us"))
    width = (
        F.when(F.col("tier") == COARSE, t.coarse_seconds * MICROS)
        .when(F.col("tier") == FINE, t.fine_seconds * MICROS)
        .otherwise(t.raw_seconds * MICROS)
    )
    return start, start + width


def buckets(samples: DataFrame, t: Tiering) -> DataFrame:
    """Retained buckets of every series: coarse, fine and the live one."""
    start, end = bucket_span(t)
    rows = fine_level(samples, t).withColumns({"start_us": start, "end_us": end})
    merged = rows.groupBy(*SERIES, "tier", "start_us", "end_us").agg(*merge_aggregates())
    back = like_input(samples)
    return with_mean_p50(merged).select(
        *SERIES,
        "tier",
        back(F.col("start_us")).alias("bucket_start"),
        back(F.col("end_us")).alias("bucket_end"),
        F.col("n").alias("sample_count"),
        *[f"{p}_{k}" for p in PREFIXES for k in ("p50", "p95", "p99", "max")],
    )


def in_order(listed: DataFrame) -> DataFrame:
    """Buckets by series, then coarse, fine and live, then start; for presentation."""
    order = F.array_position(F.array(*[F.lit(x) for x in (COARSE, FINE, LIVE)]), F.col("tier"))
    return listed.orderBy(*SERIES, order, "bucket_start")


def tier_counts(samples: DataFrame, t: Tiering) -> DataFrame:
    """Samples per series and tier; expired ones are not counted."""
    rows = slim(samples, t)
    small, large = with_clock(rows, t)
    tiered = assign_tier(small, t).unionByName(assign_tier(large, t))
    return tiered.groupBy(*SERIES, "tier").agg(F.count(F.lit(1)).alias("n"))
