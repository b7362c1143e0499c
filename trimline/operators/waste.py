"""Waste of containers, pods and nodes: request minus P95 usage, never negative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trimline.schemas import POD, SERIES


def _waste(request: Column, used: Column) -> tuple[Column, Column]:
    """``(waste, waste in percent of the request)``; both 0 without a request."""
    request = request.cast("double")
    waste = F.when(request > 0, F.greatest(request - used, F.lit(0.0))).otherwise(0.0)
    percent = F.when(request > 0, waste / request * 100).otherwise(0.0)
    return waste, percent


def container_waste(snapshots: DataFrame) -> DataFrame:
    """Waste per container from summary and metadata; a pure projection.

    CPU is reported in millicores; memory usage is the working set.
    """
    cpu = {k: F.col(f"cpu_{k}") / 1e6 for k in ("p50", "p95", "p99", "max")}
    cpu_waste, cpu_percent = _waste(F.col("cpu_request_millis"), cpu["p95"])
    mem_waste, mem_percent = _waste(F.col("mem_request_bytes"), F.col("ws_p95"))
    return snapshots.select(
        *SERIES,
        "owner_kind",
        "owner_name",
        "qos_class",
        "cpu_request_millis",
        "cpu_limit_millis",
        *[c.alias(f"cpu_{k}_millis") for k, c in cpu.items()],
        cpu_waste.alias("cpu_waste_millis"),
        cpu_percent.alias("cpu_waste_percent"),
        "mem_request_bytes",
        "mem_limit_bytes",
        *[F.col(f"ws_{k}").alias(f"mem_{k}_bytes") for k in ("p50", "p95", "p99", "max")],
        mem_waste.alias("mem_waste_bytes"),
        mem_percent.alias("mem_waste_percent"),
        "restart_count",
        "sample_count",
        "data_window_ns",
    )


def pod_waste(
    containers: DataFrame, keys: DataFrame | None = None, owners: DataFrame | None = None
) -> DataFrame:
    """Totals per pod. With ``keys`` (all known series) pods without retained data appear too.

    ``owners`` (pod_namespace, pod_name, owner_kind, owner_name) names the owners of such pods.
    """
    pods = containers.groupBy(*POD).agg(
        F.count(F.lit(1)).alias("container_count"),
        F.max("qos_class").alias("qos_class"),
        F.max(F.struct("owner_kind", "owner_name")).alias("owner"),
        F.sum("cpu_waste_millis").alias("total_cpu_waste_millis"),
        F.sum("mem_waste_bytes").alias("total_mem_waste_bytes"),
    )
    pods = pods.select(
        *POD,
        "container_count",
        "qos_class",
        "owner.owner_kind",
        "owner.owner_name",
        "total_cpu_waste_millis",
        "total_mem_waste_bytes",
    )
    if keys is None:
        return pods
    zeros = {
        "container_count": 0,
        "total_cpu_waste_millis": 0.0,
        "total_mem_waste_bytes": 0.0,
        "qos_class": "",
        "owner_kind": "",
        "owner_name": "",
    }
    listed = keys.select(*POD).distinct().join(pods, list(POD), "left")
    if owners is not None:
        by_spec = owners.select("pod_namespace", "pod_name", F.struct("owner_kind", "owner_name").alias("spec"))
        listed = listed.join(by_spec, ["pod_namespace", "pod_name"], "left")
        gone = F.col("container_count").isNull()
        for name in ("owner_kind", "owner_name"):
            listed = listed.withColumn(name, F.when(gone, F.col(f"spec.{name}")).otherwise(F.col(name)))
    return listed.select(*pods.columns).fillna(zeros)


def node_waste(pods: DataFrame) -> DataFrame:
    return pods.groupBy("node_name").agg(
        F.count(F.lit(1)).alias("pod_count"), *waste_totals()
    )


def waste_totals() -> list[Column]:
    return [
        F.sum("total_cpu_waste_millis").alias("total_cpu_waste_millis"),
        F.sum("total_mem_waste_bytes").alias("total_mem_waste_bytes"),
    ]
