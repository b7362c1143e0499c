"""Continuous tumbling buckets with a watermark.

A sample may be as late as the retention allows. A bucket is reported as soon as it has samples and again
whenever it changes (:func:`start_buckets`), so open buckets are part of the result; it is forgotten as
state when it leaves the retention.

Exact ranks need all values of a bucket, but not as an array: :func:`value_stream` keeps one small state row for each
distinct value of a bucket with the number of its samples, on the partition of that value, and
:func:`read_ranked` finds the ranks from these counts. :func:`start_rollup` keeps fine and coarse buckets in one
query: each batch merges the coarse buckets anew whose fine ones it changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trimline.functions.clock import epoch_us, floor_us
from trimline.operators.buckets import PREFIXES, merge_aggregates, with_mean_p50, without_nulls
from trimline.operators.percentiles import counted_ranks, nearest_ranks, sorted_values
from trimline.params import EXACT, Tiering
from trimline.schemas import METRICS, SERIES
from trimline.streaming.snapshots import VERSION, Snapshots, newest
from trimline.streaming.writing import trigger_of, write_batch


def _watermarked(samples: DataFrame, t: Tiering, lateness: str | None) -> DataFrame:
    values = without_nulls(samples).select(*SERIES, F.col("ts").cast("timestamp").alias("ts"), *METRICS)
    return values.withWatermark("ts", lateness or f"{t.coarse_keep_seconds} seconds")


def fine_stream(samples: DataFrame, t: Tiering, lateness: str | None = None) -> DataFrame:
    """Fine buckets of a sample stream; ``incremental`` state is a count, sums and maxima.

    A bucket stays open for late samples as long as they are retained, or for ``lateness`` if given. ``exact``
    state is an array of the bucket's values, for buckets known to be small; others go to :func:`value_stream`.
    """
    values = _watermarked(samples, t, lateness)
    grouped = values.groupBy(F.window("ts", f"{t.fine_seconds} seconds").alias("w"), *SERIES)
    count = F.count(F.lit(1)).alias("n")
    maxima = [F.max(c).alias(f"{p}_max") for c, p in METRICS.items()]
    if t.mode == EXACT:
        ranked = nearest_ranks(grouped.agg(count, *maxima, *sorted_values(METRICS)), PREFIXES)
        return ranked.withColumns({f"{p}_wsum": F.col(f"{p}_p50") * F.col("n") for p in PREFIXES})
    buckets = grouped.agg(count, *maxima, *[F.sum(c).alias(f"{p}_wsum") for c, p in METRICS.items()])
    columns = {}
    for p in PREFIXES:
        columns[f"{p}_p50"] = F.col(f"{p}_wsum") / F.col("n")
        columns[f"{p}_p95"] = columns[f"{p}_p99"] = F.col(f"{p}_max")
    return buckets.withColumns(columns)


def coarse_stream(fine: DataFrame, t: Tiering) -> DataFrame:
    """Coarse buckets chained on the fine ones, for append mode: each is reported once it is closed."""
    merged = fine.groupBy(
        F.window(F.window_time("w"), f"{t.coarse_seconds} seconds").alias("w"), *SERIES
    ).agg(*merge_aggregates())
    return with_mean_p50(merged)


def value_stream(samples: DataFrame, t: Tiering, lateness: str | None = None) -> DataFrame:
    """Fine buckets as counted values: w, series, metric, value and the number of its samples."""
    pairs = ", ".join(f"'{p}', {c}" for c, p in METRICS.items())
    values = _watermarked(samples, t, lateness).select(
        *SERIES, "ts", F.expr(f"stack({len(METRICS)}, {pairs}) AS (metric, value)")
    )
    return values.groupBy(F.window("ts", f"{t.fine_seconds} seconds").alias("w"), *SERIES, "metric", "value").agg(
        F.count(F.lit(1)).alias("weight")
    )


def read_ranked(spark: SparkSession, path: str) -> DataFrame:
    """Exact fine buckets from the counted values that :func:`start_buckets` keeps at ``path``."""
    key = [*SERIES, "bucket_start"]
    # counts only grow
    counts = spark.read.parquet(path).groupBy(*key, "metric", "value").agg(F.max("weight").alias("weight"))
    first = PREFIXES[0]
    totals = counts.groupBy(*key).agg(
        F.sum(F.when(F.col("metric") == first, F.col("weight"))).alias("n"),
        *[F.max(F.when(F.col("metric") == p, F.col("value"))).alias(f"{p}_max") for p in PREFIXES],
    )
    ranks = counted_ranks(counts, key, PREFIXES)
    same = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in key]
    ranked = totals.join(ranks, same).drop(*[f"r_{k}" for k in key])
    return ranked.withColumns({f"{p}_wsum": F.col(f"{p}_p50") * F.col("n") for p in PREFIXES})


def start_buckets(
    fine: DataFrame, path: str, checkpoint: str, interval_ms: int | None = 60_000
) -> StreamingQuery:
    """Keep a table of fine buckets, or of their counted values, at ``path``.

    Every batch adds the rows it changed, those of open buckets too.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("bucket_start", F.col("w.start")).drop("w")
        write_batch(rows, path, batch_id, partitions=())

    return (
        fine.writeStream.outputMode("update")
        .foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_of(interval_ms))
        .start()
    )


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """Each fine bucket as its last batch left it."""
    rows = spark.read.parquet(path)
    key = [*SERIES, "bucket_start"]
    newest = rows.groupBy(*key).agg(F.max("batch_id").alias("batch_id"))
    return rows.join(newest, [*key, "batch_id"], "left_semi").drop("batch_id")


def start_rollup(
    fine: DataFrame, fine_path: str, coarse_path: str, checkpoint: str, t: Tiering, interval_ms: int | None = 60_000
) -> StreamingQuery:
    """Keep fine and coarse buckets, closed and open, as tables with whole versions (:func:`read_rollup`)."""
    spark = fine.sparkSession
    kept, rolled = Snapshots(spark, fine_path, ["day"]), Snapshots(spark, coarse_path)
    key = [*SERIES, "bucket_start"]

    def roll(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumns({"bucket_start": F.col("w.start"), "day": F.to_date("w.start")}).drop("w")
        kept.merge(rows, batch_id, key)
        changed = kept.read(batch_id + 1).filter(F.col(VERSION) == batch_id)
        touched = changed.select(*SERIES, _coarse_start(t).alias("coarse_start")).distinct()
        # a coarse bucket divides a day, so its fine buckets lie in the same day partition
        days = [r["day"] for r in changed.select("day").distinct().collect()]  # at most all days
        of_days = kept.read(batch_id + 1).filter(F.col("day").isin(days)).withColumn("coarse_start", _coarse_start(t))
        parts = newest(of_days.join(touched, [*SERIES, "coarse_start"], "left_semi"), key)
        rolled.merge(coarse_buckets(parts, t), batch_id, key)

    return (
        fine.writeStream.outputMode("update")
        .foreachBatch(roll)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_of(interval_ms))
        .start()
    )


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """Each bucket of a table of :func:`start_rollup` as its last batch left it."""
    return newest(Snapshots(spark, path).read(), [*SERIES, "bucket_start"]).drop(VERSION)


def _coarse_start(t: Tiering):
    return F.timestamp_micros(floor_us(epoch_us(F.col("bucket_start")), t.coarse_seconds))


def coarse_buckets(fine: DataFrame, t: Tiering) -> DataFrame:
    """Coarse buckets of the kept fine ones, closed and open."""
    merged = fine.groupBy(*SERIES, _coarse_start(t).alias("bucket_start")).agg(*merge_aggregates())
    return with_mean_p50(merged)
