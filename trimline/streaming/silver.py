"""Silver table of fine buckets, kept up by micro-batches and read with a fixed clock."""

from __future__ import annotations

from datetime import timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trimline.functions.clock import MICROS, epoch_us, floor_us
from trimline.operators.buckets import COARSE, FINE, LIVE, PREFIXES, assign_tier, fine_level, without_nulls
from trimline.operators.percentiles import metric_aggregate
from trimline.operators.series import summarise
from trimline.params import EXACT, Tiering
from trimline.schemas import METRICS, SERIES
from trimline.streaming.snapshots import VERSION, Snapshots
from trimline.streaming.writing import trigger_of, write_batch

_KEY = (*SERIES, "bucket_us")


def partial_buckets(samples: DataFrame, t: Tiering) -> DataFrame:
    """Count, sums and maxima per series and fine bucket; partial rows merge by adding up."""
    ts = epoch_us(F.col("ts"))
    return (
        without_nulls(samples)
        .withColumn("bucket_us", floor_us(ts, t.fine_seconds))
        .groupBy(*_KEY)
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(F.col(c).cast("double")).alias(f"{p}_wsum") for c, p in METRICS.items()],
            *[F.max(F.col(c).cast("double")).alias(f"{p}_max") for c, p in METRICS.items()],
            F.min(ts).alias("first_us"),
            F.max(ts).alias("last_us"),
        )
        .withColumn("day", F.to_date(F.timestamp_micros("bucket_us")))
    )


def exact_buckets(samples: DataFrame, touched: DataFrame, t: Tiering) -> DataFrame:
    """Buckets named in ``touched`` computed anew from all their samples in bronze.

    ``touched`` has the series key (without NULL parts), ``bucket_us`` and ``day``. Give only the day partitions of bronze
    that it names: the join does not prune them.
    """
    ts = epoch_us(F.col("ts"))
    rows = without_nulls(samples).withColumn("bucket_us", floor_us(ts, t.fine_seconds))
    rows = rows.join(touched, [*_KEY, "day"], "left_semi")
    edges = [F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")]
    ranked = metric_aggregate(rows.withColumn("ts_us", ts), list(_KEY), METRICS, extra=edges, inputs=["ts_us"])
    return (
        ranked.withColumns({f"{p}_wsum": F.col(f"{p}_p50") * F.col("n") for p in PREFIXES})
        .withColumn("day", F.to_date(F.timestamp_micros("bucket_us")))
    )


def start_silver(
    spark: SparkSession,
    bronze_path: str,
    silver_path: str,
    checkpoint: str,
    t: Tiering,
    interval_ms: int | None = 300_000,
) -> StreamingQuery:
    """Follow bronze and write the buckets each batch touches.

    A sample may be late by any age within the retention: in ``incremental`` mode it becomes one
    more partial row, in ``exact`` mode its bucket is recomputed from bronze.
    """
    schema = spark.read.parquet(bronze_path).schema
    stream = spark.readStream.schema(schema).parquet(bronze_path)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        if t.mode == EXACT:
            bucket = floor_us(epoch_us(F.col("ts")), t.fine_seconds)
            touched = without_nulls(batch).withColumn("bucket_us", bucket).select(*_KEY, "day").distinct()
            days = [r["day"] for r in touched.select("day").distinct().collect()]  # at most all days
            rows = exact_buckets(spark.read.parquet(bronze_path).filter(F.col("day").isin(days)), touched, t)
        else:
            rows = partial_buckets(batch, t)
        write_batch(rows, silver_path, batch_id)

    return _start(stream, upsert, checkpoint, interval_ms)


def start_partial_silver(
    samples: DataFrame,
    silver_path: str,
    checkpoint: str,
    t: Tiering,
    interval_ms: int | None = 300_000,
) -> StreamingQuery:
    """Follow any sample stream in ``incremental`` mode; needs no bronze table."""

    def append(batch: DataFrame, batch_id: int) -> None:
        write_batch(partial_buckets(batch, t), silver_path, batch_id)

    return _start(samples, append, checkpoint, interval_ms)


def _start(stream: DataFrame, write, checkpoint: str, interval_ms: int | None) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_of(interval_ms))
        .start()
    )


def read_silver(spark: SparkSession, path: str, t: Tiering) -> DataFrame:
    """One row per series and fine bucket.

    ``incremental``: partial rows added up. ``exact``: the row of the latest batch.
    """
    rows = spark.read.parquet(path)
    if t.as_of is not None:
        rows = rows.filter(_retained_days(t))
    if t.mode == EXACT:
        fields = [c for c in rows.columns if c not in (*_KEY, "batch_id", "day")]
        return (
            rows.groupBy(*_KEY)
            .agg(F.max_by(F.struct(*fields), F.col("batch_id")).alias("r"))
            .select(*_KEY, "r.*")
        )
    merged = rows.groupBy(*_KEY).agg(
        F.sum("n").alias("n"),
        *[F.sum(f"{p}_wsum").alias(f"{p}_wsum") for p in PREFIXES],
        *[F.max(f"{p}_max").alias(f"{p}_max") for p in PREFIXES],
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
    )
    columns = {}
    for p in PREFIXES:
        columns[f"{p}_p50"] = F.col(f"{p}_wsum") / F.col("n")
        columns[f"{p}_p95"] = columns[f"{p}_p99"] = F.col(f"{p}_max")
    return merged.withColumns(columns)


def _retained_days(t: Tiering):
    now = F.lit(t.as_of.isoformat(sep=" ")).cast("timestamp")
    oldest = now - F.expr(f"INTERVAL {t.coarse_keep_seconds} SECONDS")
    return (F.col("day") >= F.to_date(oldest)) & (F.col("day") <= F.to_date(now))


def summary_from_silver(silver: DataFrame, tail: DataFrame, t: Tiering) -> DataFrame:
    """Series summary at ``t.as_of`` from silver buckets and the live tail of bronze.

    The same result as summarising all samples, without reading the settled ones: the clock has
    to lie on a fine bucket boundary, so that no silver bucket is part live and part settled.
    """
    if t.as_of is None:
        raise ValueError("a summary from silver needs a fixed clock")
    since_epoch = t.as_of.replace(tzinfo=timezone.utc).timestamp()
    if t.raw_seconds % t.fine_seconds or since_epoch % t.fine_seconds:
        raise ValueError("as_of and raw_seconds must be multiples of fine_seconds")
    clock = epoch_us(F.lit(t.as_of.isoformat(sep=" ")).cast("timestamp"))
    settled = silver.filter(F.col("bucket_us") < clock - t.raw_seconds * MICROS)
    # a settled bucket has the tier of any sample in it; its start is one such time
    tiered = assign_tier(
        settled.withColumns({"clock_us": clock, "ts_us": F.col("bucket_us")}).drop("bucket_us"), t
    ).filter(F.col("tier").isin(FINE, COARSE))
    live = fine_level(tail, t).filter(F.col("tier") == LIVE)
    return summarise(tiered.drop("ts_us").unionByName(live), t)


def compact(
    spark: SparkSession, path: str, target: str, t: Tiering, files_per_day: int = 8
) -> None:
    """Write the merged table to ``target`` as batch -1, at most ``files_per_day`` files a day."""
    merged = read_silver(spark, path, t).withColumn(
        "day", F.to_date(F.timestamp_micros("bucket_us"))
    )
    file = F.pmod(F.xxhash64(*SERIES), F.lit(files_per_day))
    write_batch(merged.repartition(F.col("day"), file), target, -1)


def publish_silver(spark: SparkSession, path: str, table_path: str, t: Tiering, version: int, first_kept_day: str) -> None:
    """Compact the silver table and evict days before ``first_kept_day`` (``yyyy-MM-dd``) as one new version.

    The merged rows go to a part of their own and readers of :func:`read_published` move from the version before to
    this one at once; ``path`` keeps its rows until :func:`drop_days_before`, so a failure in between loses nothing.
    """
    kept = F.col("day") >= F.lit(first_kept_day).cast("date")
    merged = read_silver(spark, path, t).withColumn("day", F.to_date(F.timestamp_micros("bucket_us"))).filter(kept)
    Snapshots(spark, table_path, ["day"]).replace(merged.withColumn(VERSION, F.lit(version).cast("long")), version)


def read_published(spark: SparkSession, table_path: str) -> DataFrame:
    """The buckets of the newest version of :func:`publish_silver`."""
    return Snapshots(spark, table_path).read().drop(VERSION)


def drop_days_before(spark: SparkSession, path: str, first_kept_day: str) -> list[str]:
    """Delete the day partitions of ``path`` before ``first_kept_day`` (``yyyy-MM-dd``)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = hadoop(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in files.listStatus(root)]
    old = sorted(n for n in names if n.startswith("day=") and n[4:] < first_kept_day)
    for name in old:
        files.delete(hadoop(root, name), True)
    return old
