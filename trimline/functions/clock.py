"""Epoch arithmetic for buckets. The session time zone must be UTC.

Buckets are floors of epoch microseconds: two bucket widths can then live in one projection,
which two ``window()`` expressions cannot.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS = 1_000_000


def epoch_us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def floor_us(us: Column, seconds: int) -> Column:
    return us - F.pmod(us, F.lit(seconds * MICROS))


def as_of_range(df: DataFrame, as_of: datetime, keep_seconds: int | None = None, column: str = "ts") -> Column:
    """``column`` is not after ``as_of`` (nor older than ``keep_seconds``): a range that reaches the scan.

    Where the table has its ``day`` partitions, the days are cut as well, so that they are pruned.
    """
    now = F.lit(as_of.isoformat(sep=" ")).cast(df.schema[column].dataType)
    inside = F.col(column) <= now
    if "day" in df.columns:
        inside &= F.col("day") <= F.to_date(now)
    if keep_seconds is not None:
        oldest = now - F.expr(f"INTERVAL {keep_seconds} SECONDS")
        inside &= F.col(column) >= oldest
        if "day" in df.columns:
            inside &= F.col("day") >= F.to_date(oldest)
    return inside


def like_input(df: DataFrame, column: str = "ts"):
    """Function turning epoch microseconds back into the timestamp type of ``df[column]``."""
    kind = df.schema[column].dataType.simpleString()
    return lambda us: F.timestamp_micros(us).cast(kind)
