"""Mapping of workloads to their Git source, and what to do with a mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trimline.functions.text import is_workload_kind, parse_inventory_id
from trimline.schemas import MAPPING

_COLUMNS = MAPPING.fieldNames()


def argo_mappings(resources: DataFrame) -> DataFrame:
    """``resources`` has one row per managed resource: namespace, kind, name, repo_url, path."""
    return (
        resources.filter(is_workload_kind(F.col("kind")))
        .withColumn("source_tool", F.lit("argocd"))
        .select(*_COLUMNS)
    )


def flux_mappings(inventory: DataFrame, repositories: DataFrame) -> DataFrame:
    """Inventory entries left-joined to repository URLs.

    ``inventory``: entry_id, ks_namespace, source_namespace, source_name, path. An empty source
    namespace means the kustomization's own. An unknown repository gives an empty URL; a
    repository listed twice counts once.
    """
    parsed = inventory.withColumn("entry", parse_inventory_id(F.col("entry_id"))).filter(
        is_workload_kind(F.col("entry.kind"))
    )
    own = F.when(
        F.coalesce(F.col("source_namespace"), F.lit("")) == "", F.col("ks_namespace")
    ).otherwise(F.col("source_namespace"))
    urls = repositories.groupBy(
        F.col("namespace").alias("repo_namespace"), F.col("name").alias("repo_name")
    ).agg(F.max("url").alias("url"))
    return (
        parsed.withColumn("repo_namespace", own)
        .join(
            urls.withColumnRenamed("repo_name", "source_name"),
            ["repo_namespace", "source_name"],
            "left",
        )
        .select(
            "entry.namespace",
            "entry.kind",
            "entry.name",
            F.coalesce("url", F.lit("")).alias("repo_url"),
            "path",
            F.lit("flux").alias("source_tool"),
        )
    )


def all_mappings(*sources: DataFrame | None) -> DataFrame:
    """Bag union of the mappings of every installed tool; ``None`` stands for a missing one."""
    present = [s.select(*_COLUMNS) for s in sources if s is not None]
    if not present:
        raise ValueError("no mapping source given; use empty_mappings(spark)")
    result = present[0]
    for other in present[1:]:
        result = result.unionByName(other)
    return result


def empty_mappings(spark) -> DataFrame:
    return spark.createDataFrame([], MAPPING)


def annotate_commands(mappings: DataFrame, program: str) -> DataFrame:
    """Arguments and display text of one annotate call of ``program`` per mapping."""
    target = F.concat(F.lower("kind"), F.lit("/"), F.col("name"))
    args = F.array(
        F.lit("annotate"),
        target,
        F.lit("-n"),
        F.col("namespace"),
        F.lit("--repo"),
        F.col("repo_url"),
        F.lit("--path"),
        F.col("path"),
    )
    return mappings.withColumn("args", args).withColumn(
        "display", F.concat(F.lit(f"{program} "), F.array_join("args", " "))
    )


def annotation_arguments(requests: DataFrame, domain: str) -> DataFrame:
    """Arguments that write source annotations under ``domain`` for each valid request.

    ``requests``: target, namespace, repo, path, field. Adds ``error`` (NULL when valid) and
    ``args`` (NULL when not).
    """
    target, repo, path = F.col("target"), F.col("repo"), F.col("path")
    namespace, field = (F.coalesce(F.col(c), F.lit("")) for c in ("namespace", "field"))
    blank = F.lit("")
    dashed = [F.coalesce(v, blank).startswith("-") for v in (repo, path, field)]
    error = (
        F.when(
            ~F.coalesce(target.rlike(r"(?s)^[^/]+/.+$"), F.lit(False)),
            F.concat(F.lit("target must be in kind/name format: "), F.coalesce(target, blank)),
        )
        .when(F.coalesce(repo, blank) == "", F.lit("repo is required"))
        .when(F.coalesce(path, blank) == "", F.lit("path is required"))
        .when(dashed[0] | dashed[1] | dashed[2], F.lit("values must not start with '-'"))
    )
    args = F.concat(
        F.array(F.lit("annotate"), target),
        F.when(namespace != "", F.array(F.lit("-n"), namespace)).otherwise(_no_text()),
        F.array(
            F.concat(F.lit(f"{domain}/repo="), repo), F.concat(F.lit(f"{domain}/path="), path)
        ),
        F.when(
            field != "", F.array(F.concat(F.lit(f"{domain}/field="), field))
        ).otherwise(_no_text()),
        F.array(F.lit("--overwrite")),
    )
    return requests.withColumn("error", error).withColumn(
        "args", F.when(F.col("error").isNull(), args)
    )


def _no_text() -> Column:
    return F.array().cast("array<string>")


def read_annotations(workloads: DataFrame, domain: str) -> DataFrame:
    """Source columns repo, path, field from an ``annotations`` JSON object of strings.

    ``annotation_error`` says why a workload has no usable source.
    """
    parsed = F.from_json("annotations", "map<string,string>")

    def value(name: str) -> Column:
        return F.coalesce(F.try_element_at(F.col("parsed"), F.lit(f"{domain}/{name}")), F.lit(""))

    found = workloads.withColumn("parsed", parsed).withColumns(
        {"repo": value("repo"), "path": value("path"), "field": value("field")}
    )
    missing = (F.col("repo") == "") | (F.col("path") == "")
    return found.withColumn(
        "annotation_error",
        F.when(missing, F.lit(f"missing required annotations {domain}/repo and {domain}/path")),
    ).drop("parsed")
