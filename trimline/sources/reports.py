"""Report documents, their envelopes, and the table of pushed node reports.

A report is written as JSON lines of one layout, whatever its size: one line with the totals of the node,
namespace, owner or cluster, and one line per pod. No line grows with its group, and no task gathers one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trimline.operators.rollups import OWNER, cluster, namespaces, with_owner, workloads
from trimline.operators.waste import node_waste, pod_waste, waste_totals
from trimline.schemas import POD

_RFC3339 = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, _RFC3339)


def _container() -> Column:
    def usage(metric: str, unit: str) -> Column:
        return F.struct(
            *[F.col(f"{metric}_{k}_{unit}").alias(k) for k in ("p50", "p95", "p99", "max")]
        )

    return F.struct(
        F.col("container_name").alias("containerName"),
        F.col("cpu_request_millis").alias("cpuRequestMillis"),
        usage("cpu", "millis").alias("cpuUsage"),
        F.col("cpu_waste_millis").alias("cpuWasteMillis"),
        F.col("cpu_waste_percent").alias("cpuWastePercent"),
        F.col("mem_request_bytes").alias("memoryRequestBytes"),
        usage("mem", "bytes").alias("memoryUsage"),
        F.col("mem_waste_bytes").alias("memWasteBytes"),
        F.col("mem_waste_percent").alias("memWastePercent"),
        F.col("restart_count").alias("restartCount"),
        F.col("data_window_ns").alias("dataWindow"),
    )


def _owner(kind: str, name: str, namespace: str) -> Column:
    return F.struct(
        F.col(kind).alias("kind"),
        F.col(name).alias("name"),
        F.when(F.col(kind) == "", F.lit("")).otherwise(F.col(namespace)).alias("namespace"),
    )


def pod_documents(containers: DataFrame) -> DataFrame:
    """Nested ``pod`` per pod; a pod has only a handful of containers."""
    listed = containers.groupBy(*POD).agg(
        F.array_sort(F.collect_list(_container())).alias("containers")
    )
    return pod_waste(containers).join(listed, list(POD)).select(
        *POD,
        "owner_kind",
        "owner_name",
        "total_cpu_waste_millis",
        "total_mem_waste_bytes",
        F.struct(
            F.col("pod_name").alias("podName"),
            F.col("pod_namespace").alias("podNamespace"),
            F.col("qos_class").alias("qosClass"),
            _owner("owner_kind", "owner_name", "pod_namespace").alias("ownerRef"),
            F.col("containers"),
            F.col("total_cpu_waste_millis").alias("totalCpuWasteMillis"),
            F.col("total_mem_waste_bytes").alias("totalMemWasteBytes"),
        ).alias("pod"),
    )


def _totals() -> list[Column]:
    return [
        F.col("total_cpu_waste_millis").alias("totalCpuWasteMillis"),
        F.col("total_mem_waste_bytes").alias("totalMemWasteBytes"),
    ]


def _stamp(report_time: str) -> Column:
    return rfc3339(F.lit(report_time).cast("timestamp")).alias("reportTime")


def _lines(rows: DataFrame, kind: str, keys: list[Column | str], *fields: Column) -> DataFrame:
    """``keys``, ``kind`` and a ``document`` of the fields."""
    return rows.select(*keys, F.lit(kind).alias("kind"), F.to_json(F.struct(*fields)).alias("document"))


def node_report_documents(containers: DataFrame, report_time: str) -> DataFrame:
    """JSON node reports, node_name, kind, document: a ``node`` line with totals and a line per ``pod``."""
    pods = pod_documents(containers)
    name, stamp = F.col("node_name").alias("nodeName"), _stamp(report_time)
    count = F.col("pod_count").alias("podCount")
    nodes = _lines(node_waste(pods), "node", ["node_name"], name, stamp, count, *_totals())
    return nodes.unionByName(_lines(pods, "pod", ["node_name"], name, stamp, F.col("pod")))


def empty_node_report(spark, node_name: str, report_time: str) -> DataFrame:
    """Report of a node without samples: no pods, zero totals."""
    return spark.range(1).select(
        F.lit(node_name).alias("node_name"),
        F.to_json(
            F.struct(
                F.lit(node_name).alias("nodeName"),
                rfc3339(F.lit(report_time).cast("timestamp")).alias("reportTime"),
                F.lit(None).cast("array<string>").alias("pods"),
                F.lit(0.0).alias("totalCpuWasteMillis"),
                F.lit(0.0).alias("totalMemWasteBytes"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("document"),
    )


def cluster_report_documents(
    containers: DataFrame, report_time: str, recs: DataFrame | None = None
) -> DataFrame:
    """JSON cluster reports: pod_namespace, kind, document.

    One line for the ``cluster`` (its namespace is null), one per ``namespace``, ``owner`` and ``pod``, and
    one per ``recommendation`` if ``recs`` is given. Lines below the cluster name their namespace, and
    those of pods their owner.
    """
    pods = with_owner(pod_documents(containers))
    stamp, count = _stamp(report_time), F.col("pod_count").alias("podCount")
    space = F.col("pod_namespace").alias("namespace")
    owner = _owner("owner_kind", "owner_name", "pod_namespace").alias("owner")
    keys: list[Column | str] = ["pod_namespace"]
    none = F.lit(None).cast("string").alias("pod_namespace")
    nodes = F.col("node_count").alias("nodeCount")
    lines = [
        _lines(cluster(pods), "cluster", [none], stamp, nodes, count, *_totals()),
        _lines(
            namespaces(pods), "namespace", keys, stamp, space, F.col("owner_count").alias("ownerCount"), count, *_totals()
        ),
        _lines(workloads(pods), "owner", keys, stamp, space, owner, count, *_totals()),
        _lines(pods, "pod", keys, stamp, space, owner, F.col("pod")),
    ]
    if recs is not None:
        lines.append(_lines(recs, "recommendation", keys, stamp, space, _recommendation().alias("recommendation")))
    return reduce(DataFrame.unionByName, lines)


def _recommendation() -> Column:
    target = F.struct(
        F.col("owner_kind").alias("kind"), F.col("owner_name").alias("name"), F.col("pod_namespace").alias("namespace")
    )
    return F.struct(
        target.alias("target"),
        F.col("container_name").alias("container"),
        F.col("resource"),
        F.col("current_request").alias("currentRequest"),
        F.col("current_limit").alias("currentLimit"),
        F.col("recommended_request").alias("recommendedRequest"),
        F.col("recommended_limit").alias("recommendedLimit"),
        F.col("pattern"),
        F.col("confidence"),
        F.col("reasoning"),
        F.col("est_savings").alias("estimatedSavings"),
        F.col("risk"),
        F.col("data_window_ns").alias("dataWindow"),
    )


def recommendation_documents(recs: DataFrame) -> DataFrame:
    """One JSON document per recommendation."""
    return recs.select(*OWNER, "container_name", "resource", F.to_json(_recommendation()).alias("document"))


def ok_envelope(data: Column, at: Column) -> Column:
    """Success envelope around ``data``, a struct, array or map."""
    return F.to_json(
        F.struct(F.lit("ok").alias("status"), data.alias("data"), rfc3339(at).alias("timestamp"))
    )


def error_envelope(message: Column, at: Column) -> Column:
    return F.to_json(
        F.struct(
            F.lit("error").alias("status"), message.alias("error"), rfc3339(at).alias("timestamp")
        )
    )


def decode_envelopes(
    bodies: DataFrame, data: T.DataType, column: str = "body"
) -> tuple[DataFrame, DataFrame]:
    """``(rows with column data, rows with column error)``.

    A body that is no envelope is an error, too.
    """
    schema = T.StructType(
        [
            T.StructField("status", T.StringType()),
            T.StructField("data", data),
            T.StructField("error", T.StringType()),
            T.StructField("timestamp", T.StringType()),
        ]
    )
    parsed = bodies.withColumn("e", F.from_json(column, schema))
    failed = F.coalesce((F.col("e.status") == "error") | F.col("e.status").isNull(), F.lit(True))
    reason = F.when(
        F.col("e.status") == "error",
        F.concat(F.lit("server error: "), F.coalesce("e.error", F.lit(""))),
    ).otherwise(F.lit("decoding response failed"))
    return (
        parsed.filter(~failed).select("*", "e.data", "e.timestamp").drop("e"),
        parsed.filter(failed).withColumn("error", reason).drop("e"),
    )


def latest_per_node(reports: DataFrame) -> DataFrame:
    """Newest report of each node by ``(report_time, seq)``; combined before the shuffle."""
    rest = [c for c in reports.columns if c != "node_name"]
    return (
        reports.groupBy("node_name")
        .agg(F.max_by(F.struct(*rest), F.struct("report_time", "seq")).alias("r"))
        .select("node_name", "r.*")
    )


def cluster_totals(latest: DataFrame) -> DataFrame:
    return latest.agg(F.count(F.lit(1)).alias("node_count"), *waste_totals())


def write_documents(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the ``document`` column as text, one JSON document per line."""
    documents.select(F.col("document").alias("value")).write.mode(mode).text(path)
