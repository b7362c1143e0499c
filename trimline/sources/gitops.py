"""Landed application, kustomization and repository lists as flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trimline.schemas import (
    ARGO_DOCUMENT,
    FLUX_KUSTOMIZATION_DOCUMENT,
    FLUX_REPOSITORY_DOCUMENT,
)


def _scan(spark: SparkSession, path: str, schema, multi_line: bool) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", multi_line)
    return reader.json(path).select(F.explode("items").alias("item"))


def _text(column: str, name: str):
    return F.coalesce(F.col(column), F.lit("")).alias(name)


def argo_resources(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    apps = _scan(spark, path, ARGO_DOCUMENT, multi_line)
    managed = apps.select("item.spec.source", F.explode("item.status.resources").alias("r"))
    return managed.select(
        _text("r.namespace", "namespace"),
        _text("r.kind", "kind"),
        _text("r.name", "name"),
        _text("source.repoURL", "repo_url"),
        _text("source.path", "path"),
    )


def flux_inventory(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    items = _scan(spark, path, FLUX_KUSTOMIZATION_DOCUMENT, multi_line)
    entries = items.select(
        "item.metadata", "item.spec", F.explode("item.status.inventory.entries").alias("entry")
    )
    return entries.select(
        F.col("entry.id").alias("entry_id"),
        _text("metadata.namespace", "ks_namespace"),
        _text("spec.sourceRef.namespace", "source_namespace"),
        _text("spec.sourceRef.name", "source_name"),
        _text("spec.path", "path"),
    )


def flux_repositories(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return _scan(spark, path, FLUX_REPOSITORY_DOCUMENT, multi_line).select(
        _text("item.metadata.namespace", "namespace"),
        _text("item.metadata.name", "name"),
        _text("item.spec.url", "url"),
    )
