"""Usage profiles and pattern features per workload and container."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trimline.functions.clock import MICROS, floor_us
from trimline.operators.buckets import LIVE, bucket_span, fine_level, merge_aggregates
from trimline.operators.enrich import current_specs
from trimline.operators.rollups import OWNER, with_owner
from trimline.operators.series import fill_metadata
from trimline.params import Sizing, Tiering
from trimline.schemas import SERIES, SPEC_KEY

WORKLOAD_CONTAINER = (*OWNER, "container_name")
_PREFIXES = ("cpu", "ws")
_SIZES = ("cpu_request_millis", "cpu_limit_millis", "mem_request_bytes", "mem_limit_bytes")


def series_steps(samples: DataFrame, t: Tiering, s: Sizing) -> DataFrame:
    """Retained buckets merged to one row per series and profile step.

    A week at one-hour steps is 168 rows per series, whatever the scrape rate; everything about
    recommendations is computed from these rows.
    """
    start, end = bucket_span(t)
    live = F.col("tier") == LIVE
    return (
        fine_level(samples, t)
        .withColumns(
            {
                "step_us": floor_us(F.col("bucket_us"), s.step_seconds),
                "from_us": F.when(live, F.col("first_us")).otherwise(start),
                "to_us": F.when(live, F.col("last_us")).otherwise(end),
            }
        )
        .groupBy(*SERIES, "step_us")
        .agg(
            *merge_aggregates(_PREFIXES),
            F.min("from_us").alias("from_us"),
            F.max("to_us").alias("to_us"),
        )
    )


def own(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """Attach sizes of the container and the owner of its pod."""
    parsed = current_specs(specs)
    sizes = parsed.select(*SPEC_KEY, *_SIZES)
    owners = (
        parsed.groupBy("pod_namespace", "pod_name")
        .agg(F.max(F.struct("owner_kind", "owner_name")).alias("owner"))
        .select("pod_namespace", "pod_name", "owner.*")
    )
    joined = rows.join(owners, ["pod_namespace", "pod_name"], "left").join(
        sizes, list(SPEC_KEY), "left"
    )
    return with_owner(fill_metadata(joined))


def usage_profile(steps: DataFrame, specs: DataFrame, s: Sizing) -> DataFrame:
    """Usage per workload, container and step, over all pods."""
    merged = own(steps, specs).groupBy(*WORKLOAD_CONTAINER, "step_us").agg(
        *merge_aggregates(_PREFIXES),
        F.min("from_us").alias("from_us"),
        F.max("to_us").alias("to_us"),
        *[F.max(c).alias(c) for c in _SIZES],
    )
    idle_below = F.greatest(
        F.lit(s.idle_cpu_millis), F.col("cpu_request_millis") * F.lit(s.idle_request_fraction)
    )
    return merged.withColumns(
        {
            "cpu_mean": F.col("cpu_wsum") / F.col("n") / 1e6,
            "mem_mean": F.col("ws_wsum") / F.col("n"),
            "is_idle": F.col("cpu_max") / 1e6 < idle_below,
        }
    )


def annotate(profile: DataFrame, s: Sizing) -> DataFrame:
    """Add run length and growth columns to every profile row.

    All windows lie within one workload container, which has at most one row per step of the
    retention, and share one shuffle that the aggregates after it reuse.

    ``run_start_us`` / ``run_seconds``: the unbroken run of idle steps a row belongs to (a missing
    step ends a run). ``rise``: 1 unless the working set fell since the step before.
    """
    step = s.step_seconds * MICROS
    keys = list(WORKLOAD_CONTAINER)
    in_order = Window.partitionBy(*keys).orderBy("step_us")
    position = F.row_number().over(Window.partitionBy(*keys, "is_idle").orderBy("step_us"))
    run = Window.partitionBy(*keys, "is_idle", "island_us")
    before = F.lag("mem_mean").over(in_order)
    first = F.min("step_us").over(Window.partitionBy(*keys))
    return (
        profile.withColumns(
            {
                "rise": F.when(before.isNotNull(), (F.col("mem_mean") >= before).cast("int")),
                "hours": (F.col("step_us") - first) / (3600.0 * MICROS),
                "island_us": F.col("step_us") - position * F.lit(step),
            }
        )
        .withColumns(
            {
                "run_start_us": F.min("step_us").over(run),
                "run_seconds": F.count(F.lit(1)).over(run) * F.lit(s.step_seconds),
            }
        )
        .drop("island_us")
    )


def idle_runs(annotated: DataFrame) -> DataFrame:
    """Every run of idle steps with its start and length."""
    return (
        annotated.filter("is_idle")
        .groupBy(*WORKLOAD_CONTAINER, "run_start_us")
        .agg(F.max("run_seconds").alias("run_seconds"))
    )


def _growth() -> list[Column]:
    return [
        F.count("rise").alias("growth_steps"),
        F.coalesce(F.avg("rise"), F.lit(0.0)).alias("growth_share"),
        F.coalesce(F.regr_slope("mem_mean", "hours"), F.lit(0.0)).alias("growth_slope"),
    ]


def memory_growth(annotated: DataFrame) -> DataFrame:
    """Steps, share of steps without a fall, and slope in bytes per hour of the working set."""
    return annotated.groupBy(*WORKLOAD_CONTAINER).agg(*_growth())


def features(annotated: DataFrame) -> DataFrame:
    """One row per workload and container: merged usage and everything the classifier needs."""
    usage = annotated.groupBy(*WORKLOAD_CONTAINER).agg(
        *merge_aggregates(_PREFIXES),
        *[F.max(c).alias(c) for c in _SIZES],
        ((F.max("to_us") - F.min("from_us")) * 1000).alias("data_window_ns"),
        F.count(F.lit(1)).alias("steps"),
        F.avg("cpu_mean").alias("step_mean"),
        F.stddev_pop("cpu_mean").alias("step_sd"),
        F.avg(F.col("is_idle").cast("int")).alias("idle_share"),
        # the run that reaches the end of the window: a quiet spell in the past makes nothing idle now
        F.max_by(F.when(F.col("is_idle"), F.col("run_seconds")).otherwise(0), "step_us").alias("idle_seconds"),
        *_growth(),
    )
    cpu_p50 = F.col("cpu_wsum") / F.col("n")
    return usage.withColumns(
        {
            "cpu_p50": cpu_p50,
            "ws_p50": F.col("ws_wsum") / F.col("n"),
            "variation": F.coalesce(F.try_divide("step_sd", F.col("step_mean")), F.lit(0.0)),
            "peak_ratio": F.coalesce(F.try_divide(F.col("cpu_max"), cpu_p50), F.lit(0.0)),
        }
    ).drop("cpu_wsum", "ws_wsum", "step_mean", "step_sd")


def classify(features: DataFrame, s: Sizing) -> DataFrame:
    """Add ``pattern``; the first rule that applies wins."""
    pattern = (
        F.when(F.col("idle_seconds") >= s.idle_seconds, "idle")
        .when(
            (F.col("growth_steps") >= s.growth_min_steps)
            & (F.col("growth_share") >= s.growth_share)
            & (F.col("growth_slope") > 0),
            "anomalous",
        )
        .when(
            (F.col("peak_ratio") >= s.batch_peak_ratio)
            & (F.col("idle_share") >= s.batch_idle_share),
            "batch",
        )
        .when(
            (F.col("peak_ratio") >= s.burst_peak_ratio)
            | (F.col("variation") >= s.burst_variation),
            "burstable",
        )
        .otherwise("steady")
    )
    return features.withColumn("pattern", pattern)
