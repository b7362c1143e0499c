"""Tables a report reader sees. Megabytes are decimal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trimline.functions.text import whole_percent
from trimline.operators.rollups import OWNER, namespaces, with_owner, workloads

_TOTALS = ("total_cpu_waste_millis", "total_mem_waste_bytes")


def _waste_columns() -> list[Column]:
    return [
        F.rint("total_cpu_waste_millis").cast("bigint").alias("cpu_waste_millis"),
        F.rint(F.col("total_mem_waste_bytes") / 1e6).cast("bigint").alias("mem_waste_mb"),
    ]


def cluster_table(pods: DataFrame) -> DataFrame:
    return namespaces(pods).select(
        "pod_namespace", "owner_count", "pod_count", *_waste_columns()
    )


def namespace_table(pods: DataFrame, namespace: str) -> DataFrame:
    """Workloads of one namespace; the filter moves down to the pod rows."""
    return (
        workloads(pods)
        .filter(F.col("pod_namespace") == namespace)
        .select("owner_name", "owner_kind", "pod_count", *_waste_columns())
    )


def workloads_table(pods: DataFrame) -> DataFrame:
    return workloads(pods).select(
        "pod_namespace", "owner_kind", "owner_name", "pod_count", *_waste_columns()
    )


def workload_detail(containers: DataFrame) -> DataFrame:
    """Per container of every workload: requests, P95 and waste percent in display units."""
    return with_owner(containers).select(
        *OWNER,
        "node_name",
        "pod_name",
        "container_name",
        "cpu_request_millis",
        F.rint("cpu_p95_millis").cast("bigint").alias("cpu_p95_millis"),
        F.rint("cpu_waste_percent").cast("bigint").alias("cpu_waste_percent"),
        F.call_function("div", F.col("mem_request_bytes"), F.lit(1_000_000)).alias(
            "mem_request_mb"
        ),
        F.rint(F.col("mem_p95_bytes") / 1e6).cast("bigint").alias("mem_p95_mb"),
        F.rint("mem_waste_percent").cast("bigint").alias("mem_waste_percent"),
    )


def one_workload(table: DataFrame, namespace: str, kind: str, name: str) -> DataFrame:
    return table.filter(
        (F.col("pod_namespace") == namespace)
        & (F.col("owner_kind") == kind)
        & (F.col("owner_name") == name)
    )


def recommendations_table(ranked: DataFrame) -> DataFrame:
    return ranked.select(
        F.concat_ws("/", "pod_namespace", "owner_name").alias("target"),
        "container_name",
        "resource",
        "current_request",
        "recommended_request",
        "est_savings",
        "risk",
        whole_percent(F.col("confidence")).alias("confidence_percent"),
    )


def top_workloads(pods: DataFrame, k: int) -> DataFrame:
    """The ``k`` workloads with the largest CPU waste; ties by owner."""
    return (
        workloads(pods)
        .orderBy(F.desc("total_cpu_waste_millis"), *OWNER)
        .limit(k)
    )


def top_workloads_by_namespace(pods: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest wasters of each namespace; cut per task before the shuffle."""
    order = Window.partitionBy("pod_namespace").orderBy(
        F.desc("total_cpu_waste_millis"), "owner_kind", "owner_name"
    )
    return (
        workloads(pods)
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= k)
    )


def waste_by_namespace(pods: DataFrame) -> DataFrame:
    return namespaces(pods).select("pod_namespace", *_TOTALS)
