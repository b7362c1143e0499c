"""Change requests: recommendations joined to their source, title, body, branch and file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trimline.functions.text import branch_name, change_body, change_title
from trimline.operators.recommend import one_per_target

DEFAULT_FOOTER = "Generated by trimline"


def with_source(recs: DataFrame, sources: DataFrame) -> DataFrame:
    """Inner join on namespace, kind without case, and name.

    ``sources``: namespace, kind, name plus source columns.
    """
    renamed = sources.select(
        F.col("namespace").alias("pod_namespace"),
        F.lower("kind").alias("kind_key"),
        F.col("name").alias("owner_name"),
        *[c for c in sources.columns if c not in ("namespace", "kind", "name")],
    )
    return (
        recs.withColumn("kind_key", F.lower("owner_kind"))
        .join(renamed, ["pod_namespace", "kind_key", "owner_name"])
        .drop("kind_key")
    )


def with_texts(recs: DataFrame, footer: str = DEFAULT_FOOTER) -> DataFrame:
    """Add ``title`` and ``body``."""
    body = change_body(
        kind=F.col("owner_kind"),
        name=F.col("owner_name"),
        namespace=F.col("pod_namespace"),
        pattern=F.col("pattern"),
        confidence=F.col("confidence"),
        risk=F.col("risk"),
        resource=F.col("resource"),
        current_request=F.col("current_request"),
        recommended_request=F.col("recommended_request"),
        current_limit=F.col("current_limit"),
        recommended_limit=F.col("recommended_limit"),
        reasoning=F.col("reasoning"),
        footer=footer,
    )
    return recs.withColumns(
        {"title": change_title(F.col("owner_kind"), F.col("owner_name")), "body": body}
    )


def change_requests(
    recs: DataFrame,
    sources: DataFrame,
    order: list[str],
    created_at: str,
    branch_prefix: str = "right-size",
    footer: str = DEFAULT_FOOTER,
) -> DataFrame:
    """One change request per target that has a source.

    ``sources``: namespace, kind, name, repo, path, field, ``annotation_error``. A target whose
    annotations are unusable stays in the result with its ``error``.
    """
    joined = with_texts(with_source(one_per_target(recs, order), sources), footer)
    return joined.withColumn(
        "branch",
        branch_name(
            F.lit(branch_prefix),
            F.col("pod_namespace"),
            F.col("owner_name"),
            F.lit(created_at).cast("timestamp"),
        ),
    ).withColumnRenamed("annotation_error", "error")


def manifest_edits(requests: DataFrame, manifests: DataFrame) -> DataFrame:
    """Change requests joined to the manifest files they touch, on repository and path."""
    return requests.filter(F.col("error").isNull()).drop("error").join(
        manifests.select("repo", "path", "content"), ["repo", "path"]
    )
