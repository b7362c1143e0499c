"""Landed usage and pod documents as flat rows.

One JSON document per line, or per file with ``multi_line``. A document may carry ``scraped_at``
and ``seq``; without it the file's modification time counts as scrape time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trimline.functions.owners import resolve
from trimline.functions.quantities import cpu_millis, memory_bytes
from trimline.schemas import POD_LIST_DOCUMENT, USAGE_DOCUMENT

CORRUPT = "_corrupt_record"


def document_schema(document: T.StructType) -> T.StructType:
    return T.StructType(
        [
            *document.fields,
            T.StructField("scraped_at", T.TimestampType()),
            T.StructField("seq", T.LongType()),
            T.StructField(CORRUPT, T.StringType()),
        ]
    )


def read_documents(
    spark: SparkSession,
    path: str,
    document: T.StructType = USAGE_DOCUMENT,
    *,
    streaming: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """Batch or streaming scan of landed documents, unreadable ones kept in ``_corrupt_record``."""
    reader = spark.readStream if streaming else spark.read
    found = (
        reader.schema(document_schema(document))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("multiLine", multi_line)
        .json(path)
    )
    return found.withColumns(
        {
            "scraped_at": F.coalesce("scraped_at", "_metadata.file_modification_time"),
            "seq": F.coalesce("seq", F.lit(0).cast("bigint")),
        }
    )


def readable(documents: DataFrame) -> DataFrame:
    """Documents that could be parsed; a failed scrape is skipped, not fatal."""
    return documents.filter(F.col(CORRUPT).isNull())


def rejected(documents: DataFrame) -> DataFrame:
    """Text and scrape time of documents that could not be parsed."""
    return documents.filter(F.col(CORRUPT).isNotNull()).select("scraped_at", CORRUPT)


def usage_samples(documents: DataFrame) -> DataFrame:
    """One row per container sample. Absent usage is 0; a pod without containers gives no row."""
    pods = documents.select(
        F.coalesce("node.nodeName", F.lit("")).alias("node_name"),
        F.col("scraped_at").alias("ts"),
        "seq",
        F.explode("pods").alias("pod"),
    )
    containers = pods.select(
        "node_name", "ts", "seq", "pod.podRef", F.explode("pod.containers").alias("c")
    )

    def usage(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(0).cast("decimal(20,0)"))

    return containers.select(
        "node_name",
        F.coalesce("podRef.namespace", F.lit("")).alias("pod_namespace"),
        F.coalesce("podRef.name", F.lit("")).alias("pod_name"),
        F.coalesce("c.name", F.lit("")).alias("container_name"),
        "ts",
        "seq",
        usage("c.cpu.usageNanoCores").alias("cpu_nano"),
        usage("c.memory.usageBytes").alias("mem_usage"),
        usage("c.memory.workingSetBytes").alias("mem_ws"),
    )


def read_pod_documents(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_documents(spark, path, POD_LIST_DOCUMENT, **options)


def pod_specs(documents: DataFrame) -> DataFrame:
    """One row per container of a pod list, with parsed sizes, restarts and owner.

    A container named twice in the status keeps its last restart count.
    """
    items = documents.select("scraped_at", "seq", F.explode("items").alias("item"))
    containers = items.select(
        "scraped_at",
        "seq",
        "item.metadata",
        "item.status",
        F.explode("item.spec.containers").alias("c"),
    )
    status = F.try_element_at(
        F.filter("status.containerStatuses", lambda x: x["name"] == F.col("c.name")), F.lit(-1)
    )
    owner = resolve(F.col("metadata.ownerReferences"))
    return containers.select(
        F.coalesce("metadata.namespace", F.lit("")).alias("pod_namespace"),
        F.coalesce("metadata.name", F.lit("")).alias("pod_name"),
        F.coalesce("c.name", F.lit("")).alias("container_name"),
        cpu_millis(F.col("c.resources.requests.cpu")).alias("cpu_request_millis"),
        cpu_millis(F.col("c.resources.limits.cpu")).alias("cpu_limit_millis"),
        memory_bytes(F.col("c.resources.requests.memory")).alias("mem_request_bytes"),
        memory_bytes(F.col("c.resources.limits.memory")).alias("mem_limit_bytes"),
        F.coalesce(status["restartCount"], F.lit(0)).alias("restart_count"),
        F.coalesce("status.qosClass", F.lit("")).alias("qos_class"),
        owner["kind"].alias("owner_kind"),
        owner["name"].alias("owner_name"),
        "scraped_at",
        "seq",
    )
