"""Size proposals, safety limits, risk, ranking and digest of recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trimline.functions.clock import MICROS
from trimline.operators.rollups import OWNER
from trimline.params import Sizing

PATTERNS = ("steady", "burstable", "batch", "idle", "anomalous")
RISKS = ("LOW", "MEDIUM", "HIGH")

# from least to most urgent
SEVERITIES = ("info", "optimisation", "warning")


def confidence(data_window_ns: Column, sample_count: Column, s: Sizing) -> Column:
    """0..1: share of a full window and of a full sample count, weighted."""
    window = F.least(F.lit(1.0), data_window_ns / (s.full_window_seconds * 1e9))
    samples = F.least(F.lit(1.0), sample_count / float(s.full_samples))
    return F.round(window * s.window_weight + samples * (1 - s.window_weight), 4)


def reduction_cap(conf: Column, s: Sizing) -> Column:
    return (
        F.when(conf < s.low_confidence, s.cap_low)
        .when(conf < s.high_confidence, s.cap_medium)
        .otherwise(s.cap_high)
    )


def _ceil(value: Column) -> Column:
    return F.ceil(value).cast("bigint")


def _by_pattern(steady: Column, burstable: Column, batch: Column) -> Column:
    """Value of a resizable pattern; NULL for flagged ones, which keep their size."""
    pattern = F.col("pattern")
    return (
        F.when(pattern == "steady", steady)
        .when(pattern == "burstable", burstable)
        .when(pattern == "batch", batch)
    )


def recommendations(classified: DataFrame, s: Sizing) -> DataFrame:
    """One row per workload, container and resource.

    Order of rules: proposal by pattern, then the reduction cap, then the safety limits, which
    win over the cap.
    """
    conf = confidence(F.col("data_window_ns"), F.col("n"), s)
    both = F.array(
        F.struct(
            F.lit("cpu").alias("resource"),
            F.col("cpu_request_millis").alias("current_request"),
            F.col("cpu_limit_millis").alias("current_limit"),
            (F.col("cpu_p50") / 1e6).alias("p50"),
            (F.col("cpu_p95") / 1e6).alias("p95"),
            (F.col("cpu_p99") / 1e6).alias("p99"),
            (F.col("cpu_max") / 1e6).alias("peak"),
            F.lit(s.cpu_floor_millis).cast("bigint").alias("floor"),
        ),
        F.struct(
            F.lit("memory").alias("resource"),
            F.col("mem_request_bytes").alias("current_request"),
            F.col("mem_limit_bytes").alias("current_limit"),
            F.col("ws_p50").alias("p50"),
            F.col("ws_p95").alias("p95"),
            F.col("ws_p99").alias("p99"),
            F.col("ws_max").alias("peak"),
            F.greatest(
                F.lit(s.memory_floor_bytes).cast("bigint"),
                _ceil(F.col("ws_p99") * s.memory_p99_factor),
            ).alias("floor"),
        ),
    )
    rows = classified.withColumns({"confidence": conf, "usage": F.explode(both)}).select(
        *OWNER,
        "container_name",
        "pattern",
        "confidence",
        "data_window_ns",
        "usage.*",
    )

    p50, p95, peak = F.col("p50"), F.col("p95"), F.col("peak")
    request = _by_pattern(
        p95 * s.steady_headroom, p50 * s.burst_headroom, p95 * s.batch_headroom
    )
    limit = _by_pattern(peak * s.steady_limit, peak * s.burst_limit, peak * s.batch_limit)
    lowest = F.col("current_request") * (1 - reduction_cap(F.col("confidence"), s))
    # flagged containers keep their size; greatest() alone would skip their missing proposal
    capped = F.when(request.isNotNull(), F.greatest(_ceil(request), _ceil(lowest))).otherwise(
        F.col("current_request")
    )
    rows = rows.withColumn("recommended_request", F.greatest(capped, F.col("floor")))
    # a flagged container without a limit stays without one
    kept_limit = F.when(
        F.col("current_limit") > 0, F.greatest("current_limit", "recommended_request")
    ).otherwise(F.lit(0).cast("bigint"))
    rows = rows.withColumns(
        {
            "recommended_limit": F.when(
                limit.isNotNull(), F.greatest(_ceil(limit), F.col("recommended_request"))
            ).otherwise(kept_limit),
            "est_savings": F.col("current_request") - F.col("recommended_request"),
        }
    )
    reduction = F.when(
        F.col("current_request") > 0, F.col("est_savings") / F.col("current_request")
    ).otherwise(0.0)
    risk = (
        F.when(
            (F.col("confidence") < s.low_confidence) | (reduction > s.risk_high_reduction), "HIGH"
        )
        .when(
            (F.col("confidence") >= s.high_confidence) & (reduction <= s.risk_low_reduction),
            "LOW",
        )
        .otherwise("MEDIUM")
    )
    unit = F.when(F.col("resource") == "cpu", "m").otherwise(" bytes")

    def shown(value: Column) -> Column:
        return F.concat(F.rint(value).cast("bigint").cast("string"), unit)

    reasoning = F.concat_ws(
        "",
        F.col("pattern"),
        F.lit(" "),
        F.col("resource"),
        F.lit(" usage: P50 "),
        shown(p50),
        F.lit(", P95 "),
        shown(p95),
        F.lit(", max "),
        shown(peak),
        F.when(limit.isNull(), F.lit("; flagged for investigation")),
    )
    return rows.select(
        *OWNER,
        "container_name",
        "resource",
        "current_request",
        "current_limit",
        "recommended_request",
        "recommended_limit",
        "pattern",
        "confidence",
        reasoning.alias("reasoning"),
        "est_savings",
        risk.alias("risk"),
        "data_window_ns",
    )


def filter_recommendations(
    recs: DataFrame, risk: str | None = None, namespace: str | None = None
) -> DataFrame:
    if risk:
        recs = recs.filter(F.upper("risk") == risk.upper())
    if namespace:
        recs = recs.filter(F.col("pod_namespace") == namespace)
    return recs


def valid_recommendations(recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows with known pattern and risk, the others)``."""
    known = F.coalesce(
        F.col("pattern").isin(*PATTERNS) & F.col("risk").isin(*RISKS), F.lit(False)
    )
    return recs.filter(known), recs.filter(~known)


def by_savings(recs: DataFrame) -> DataFrame:
    """Global order by savings. CPU and memory are compared as plain numbers."""
    return recs.orderBy(F.desc("est_savings"), *OWNER, "container_name", "resource")


def by_confidence(recs: DataFrame) -> DataFrame:
    return recs.orderBy(F.desc("confidence"), *OWNER, "container_name", "resource")


def savings_by_resource(recs: DataFrame) -> DataFrame:
    return recs.groupBy("resource").agg(
        F.count(F.lit(1)).alias("recommendations"), F.sum("est_savings").alias("est_savings")
    )


def one_per_target(recs: DataFrame, order: list[str]) -> DataFrame:
    """Per target the first CPU row by ``order``, else its first row.

    A minimum over a struct, so rows are combined before the shuffle. Kinds compare without
    case, names with it.
    """
    key = F.struct((F.col("resource") != "cpu").alias("not_cpu"), *order)
    fields = F.struct(*recs.columns)
    return (
        recs.groupBy(
            F.col("pod_namespace").alias("k_ns"),
            F.lower("owner_kind").alias("k_kind"),
            F.col("owner_name").alias("k_name"),
        )
        .agg(F.min_by(fields, key).alias("rec"))
        .select("rec.*")
    )


def digest(
    recs: DataFrame, min_severity: str = "optimisation", interval_seconds: int = 3600
) -> DataFrame:
    """Rows to notify about: one per target, container, resource and interval, the first by
    ``(ts, seq)``, at or above ``min_severity``.

    The result stays flat; grouping by namespace is left to the reader, as one namespace may
    hold most rows.
    """
    severity = F.when(F.col("pattern").isin("idle", "anomalous"), "warning").when(
        F.col("est_savings") > 0, "optimisation"
    ).otherwise("info")
    wanted = SEVERITIES[SEVERITIES.index(min_severity):]
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    start = us - F.pmod(us, F.lit(interval_seconds * MICROS))
    keys = [*OWNER, "container_name", "resource"]
    rest = [c for c in recs.columns if c not in keys]
    return (
        recs.withColumn("severity", severity)
        .filter(F.col("severity").isin(*wanted))
        .groupBy(F.timestamp_micros(start).alias("digest_start"), *keys)
        .agg(F.min_by(F.struct("severity", *rest), F.struct("ts", "seq")).alias("first"))
        .select("digest_start", *keys, "first.*")
    )
