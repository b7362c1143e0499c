"""Bronze table of raw samples: parquet partitioned by day."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trimline.params import Tiering


def write_samples(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Append samples; the day partition lets every time-bounded read skip old files."""
    samples.withColumn("day", F.to_date("ts")).write.mode(mode).partitionBy("day").parquet(path)


def read_samples(spark: SparkSession, path: str, t: Tiering) -> DataFrame:
    """Samples of the retention range. With a fixed clock, old and later days are not listed."""
    samples = spark.read.parquet(path)
    if t.as_of is not None:
        samples = samples.filter(_days(t.as_of, t.coarse_keep_seconds))
    return samples


def read_tail(spark: SparkSession, path: str, t: Tiering) -> DataFrame:
    """Samples of the live tier at ``t.as_of``: the newest one or two day partitions."""
    if t.as_of is None:
        raise ValueError("reading the tail needs a fixed clock")
    now = F.lit(t.as_of.isoformat(sep=" ")).cast("timestamp")
    return (
        spark.read.parquet(path)
        .filter(_days(t.as_of, t.raw_seconds))
        .filter((F.col("ts") <= now) & (F.col("ts") >= now - F.expr(f"INTERVAL {t.raw_seconds} SECONDS")))
    )


def _days(as_of: datetime, keep_seconds: int):
    now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp")
    oldest = now - F.expr(f"INTERVAL {keep_seconds} SECONDS")
    return (F.col("day") >= F.to_date(oldest)) & (F.col("day") <= F.to_date(now))
