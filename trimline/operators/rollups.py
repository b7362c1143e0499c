"""Roll-ups of pod waste to workloads, namespaces and the cluster.

A pod row is one ``(node, namespace, pod)``; pods without an owner are their own workload of
kind ``Pod``. Totals never need a distinct: pod rows are unique already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trimline.operators.buckets import merge_aggregates, with_mean_p50
from trimline.operators.waste import waste_totals

OWNER = ("pod_namespace", "owner_kind", "owner_name")


def with_owner(df: DataFrame) -> DataFrame:
    """Fill the owner of owner-less pods with the pod itself."""
    none = F.coalesce(F.col("owner_kind"), F.lit("")) == ""
    return df.withColumns(
        {
            "owner_name": F.when(none, F.col("pod_name")).otherwise(F.col("owner_name")),
            "owner_kind": F.when(none, F.lit("Pod")).otherwise(F.col("owner_kind")),
        }
    )


def workloads(pods: DataFrame) -> DataFrame:
    return (
        with_owner(pods)
        .groupBy(*OWNER)
        .agg(F.count(F.lit(1)).alias("pod_count"), *waste_totals())
    )


def namespaces(pods: DataFrame) -> DataFrame:
    """Owners, pods and totals per namespace, rolled up from workloads.

    Two small hash aggregates; the owner count needs no distinct because workload rows are
    unique.
    """
    return (
        workloads(pods)
        .groupBy("pod_namespace")
        .agg(
            F.count(F.lit(1)).alias("owner_count"),
            F.sum("pod_count").alias("pod_count"),
            *waste_totals(),
        )
    )


def cluster(pods: DataFrame) -> DataFrame:
    """One row for the cluster, rolled up from nodes."""
    per_node = pods.groupBy("node_name").agg(
        F.count(F.lit(1)).alias("pod_count"), *waste_totals()
    )
    return per_node.agg(
        F.count(F.lit(1)).alias("node_count"),
        F.coalesce(F.sum("pod_count"), F.lit(0)).alias("pod_count"),
        *[
            F.coalesce(F.sum(c), F.lit(0.0)).alias(c)
            for c in ("total_cpu_waste_millis", "total_mem_waste_bytes")
        ],
    )


def all_levels(pods: DataFrame) -> DataFrame:
    """Node, namespace, workload and cluster totals in one pass.

    Pods are reduced to ``(node, workload)`` first, so the expansion to four grouping sets works
    on that smaller table and not on pod rows.
    """
    reduced = (
        with_owner(pods)
        .groupBy("node_name", *OWNER)
        .agg(F.count(F.lit(1)).alias("pods"), *waste_totals())
    )
    levels = reduced.groupingSets(
        [
            ["node_name"],
            ["pod_namespace"],
            ["pod_namespace", "owner_kind", "owner_name"],
            [],
        ],
        "node_name",
        *OWNER,
    ).agg(F.grouping_id().alias("gid"), F.sum("pods").alias("pod_count"), *waste_totals())
    level = (
        F.when(F.col("gid") == 0b0111, "node")
        .when(F.col("gid") == 0b1011, "namespace")
        .when(F.col("gid") == 0b1000, "workload")
        .otherwise("cluster")
    )
    return levels.select(
        level.alias("level"),
        "node_name",
        *OWNER,
        "pod_count",
        "total_cpu_waste_millis",
        "total_mem_waste_bytes",
    )


def workload_usage(snapshots: DataFrame) -> DataFrame:
    """Merged usage per workload and container over all its pods and nodes.

    Same merge rule as for buckets. Requests and limits are the largest of the pods. Takes
    series snapshots.
    """
    prefixes = ("cpu", "ws")
    owned = with_owner(snapshots).withColumns(
        {f"{p}_wsum": F.col(f"{p}_p50") * F.col("sample_count") for p in prefixes}
        | {"n": F.col("sample_count")}
    )
    merged = owned.groupBy(*OWNER, "container_name").agg(
        *merge_aggregates(prefixes),
        F.count(F.lit(1)).alias("series_count"),
        *[
            F.max(c).alias(c)
            for c in (
                "cpu_request_millis",
                "cpu_limit_millis",
                "mem_request_bytes",
                "mem_limit_bytes",
                "data_window_ns",
            )
        ],
    )
    return with_mean_p50(merged, prefixes).drop(*[f"{p}_wsum" for p in prefixes])
