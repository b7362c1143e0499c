"""Joins of samples or series with pod specs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trimline.functions.clock import epoch_us, floor_us
from trimline.functions.owners import promote
from trimline.functions.quantities import cpu_millis, memory_bytes
from trimline.operators.series import fill_metadata
from trimline.schemas import METADATA_DEFAULTS, SPEC_KEY


def parse_specs(specs: DataFrame) -> DataFrame:
    """Quantities to numbers and owners to workloads.

    Takes ``cpu_request cpu_limit mem_request mem_limit`` as text (missing columns count as
    unset) and ``owner_kind`` / ``owner_name`` as found on the pod.
    """
    have = set(specs.columns)

    def text(name: str):
        return F.col(name) if name in have else F.lit("")

    owner = promote(F.col("owner_kind"), F.col("owner_name"))
    extra = [c for c in ("scraped_at", "ts", "seq") if c in have]
    return specs.select(
        *SPEC_KEY,
        cpu_millis(text("cpu_request")).alias("cpu_request_millis"),
        cpu_millis(text("cpu_limit")).alias("cpu_limit_millis"),
        memory_bytes(text("mem_request")).alias("mem_request_bytes"),
        memory_bytes(text("mem_limit")).alias("mem_limit_bytes"),
        F.col("restart_count").cast("int").alias("restart_count"),
        "qos_class",
        owner["kind"].alias("owner_kind"),
        owner["name"].alias("owner_name"),
        *extra,
    )


def current_specs(specs: DataFrame) -> DataFrame:
    """Parsed specs with one row per container: the last one by ``scraped_at`` and ``seq``, where given.

    A table without these columns has no order; of rows that repeat a key in it the largest counts.
    """
    parsed = parse_specs(specs)
    order = [c for c in ("scraped_at", "ts", "seq") if c in parsed.columns]
    rest = [c for c in parsed.columns if c in METADATA_DEFAULTS]
    return last_spec(parsed, [*order, *rest])


def last_spec(specs: DataFrame, order: list[str]) -> DataFrame:
    """One spec per container key: the last one by ``order``."""
    fields = F.struct(*[c for c in specs.columns if c in METADATA_DEFAULTS])
    return (
        specs.groupBy(*SPEC_KEY)
        .agg(F.max_by(fields, F.struct(*order)).alias("spec"))
        .select(*SPEC_KEY, "spec.*")
    )


def enrich_samples(samples: DataFrame, specs: DataFrame, same_scrape: bool = False) -> DataFrame:
    """Samples with the metadata of their container; unmatched ones get zeros and ''.

    ``specs`` has one row per container key, or per key and ``scraped_at`` with ``same_scrape``.
    For reports over a fixed spec table use :func:`enrich_series`, which joins after reduction.
    """
    keys = [*SPEC_KEY, "scraped_at"] if same_scrape else list(SPEC_KEY)
    return fill_metadata(samples.join(specs, keys, "left"))


def enrich_series(series: DataFrame, specs: DataFrame) -> DataFrame:
    """Same as enriching every sample when a key has one spec, at one row per series."""
    return fill_metadata(series.join(specs, list(SPEC_KEY), "left"))


def enrich_as_of(samples: DataFrame, specs: DataFrame, chunk_seconds: int = 3600) -> DataFrame:
    """Samples with the latest spec at or before their time.

    ``specs`` carries ``ts`` and ``seq``. Rows are handled per series *and time chunk*, so a busy
    series spreads over its chunks. The spec valid when a chunk begins comes from a scan over per-chunk
    summaries (the last spec of a chunk, and the chunks that have samples) and is put in the chunk as its first
    row, so samples are shuffled once and joined to nothing.
    """
    keys = list(SPEC_KEY)
    fields = [c for c in specs.columns if c in METADATA_DEFAULTS]
    chunk = floor_us(epoch_us(F.col("ts")), chunk_seconds)
    order = F.struct("ts", "seq")

    changes = specs.select(
        *keys, "ts", "seq", chunk.alias("chunk_us"), F.struct(*fields).alias("spec")
    )
    closing = changes.groupBy(*keys, "chunk_us").agg(F.max_by("spec", order).alias("closing"))
    # combined before the shuffle: one row per chunk, not per sample
    chunks = samples.select(*keys, chunk.alias("chunk_us"), F.lit(True).alias("sampled")).distinct()
    before = Window.partitionBy(*keys).orderBy("chunk_us").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = (
        chunks.join(closing, [*keys, "chunk_us"], "full")
        .withColumn("carried", F.last("closing", ignorenulls=True).over(before))
        .filter(F.col("sampled") & F.col("carried").isNotNull())
    )

    sample_columns = [c for c in samples.columns if c not in keys]
    left = samples.select(
        *keys,
        chunk.alias("chunk_us"),
        F.col("ts").alias("at"),
        F.lit(1).alias("side"),
        F.struct(*sample_columns).alias("sample"),
        F.lit(None).cast(changes.schema["spec"].dataType).alias("spec"),
        F.lit(None).cast("bigint").alias("order_seq"),
    )
    right = changes.select(
        *keys,
        "chunk_us",
        F.col("ts").alias("at"),
        F.lit(0).alias("side"),
        F.lit(None).cast(left.schema["sample"].dataType).alias("sample"),
        "spec",
        F.col("seq").alias("order_seq"),
    )
    first = carried.select(
        *keys,
        "chunk_us",
        F.timestamp_micros("chunk_us").cast(samples.schema["ts"].dataType).alias("at"),
        F.lit(-1).alias("side"),
        F.lit(None).cast(left.schema["sample"].dataType).alias("sample"),
        F.col("carried").alias("spec"),
        F.lit(None).cast("bigint").alias("order_seq"),
    )
    so_far = (
        Window.partitionBy(*keys, "chunk_us")
        .orderBy("at", "side", "order_seq")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    seen = (
        left.unionByName(right)
        .unionByName(first)
        .withColumn("seen", F.last("spec", ignorenulls=True).over(so_far))
        .filter(F.col("side") == 1)
    )
    joined = seen.select(*keys, "sample.*", F.col("seen").alias("spec"))
    return fill_metadata(joined.select(*keys, *sample_columns, "spec.*"))
