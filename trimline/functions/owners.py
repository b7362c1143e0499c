"""Owner resolution from a pod's owner references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def deployment_name(replica_set: Column) -> Column:
    """Name without its trailing ``-hash`` part; empty when there is no such part."""
    return F.regexp_extract(replica_set, r"(?s)^(.+)-[^-]*$", 1)


def promote(kind: Column, name: Column) -> Column:
    """``struct(kind, name)`` with a ReplicaSet replaced by the Deployment that made it."""
    kind, name = F.coalesce(kind, F.lit("")), F.coalesce(name, F.lit(""))
    deployment = deployment_name(name)
    made_by_deployment = (kind == "ReplicaSet") & (deployment != "")
    return F.struct(
        F.when(made_by_deployment, F.lit("Deployment")).otherwise(kind).alias("kind"),
        F.when(made_by_deployment, deployment).otherwise(name).alias("name"),
    )


def resolve(references: Column) -> Column:
    """Owner of a pod: its first controlling reference, else its first reference."""
    first = F.try_element_at(references, F.lit(1))
    controller = F.try_element_at(
        F.filter(references, lambda r: F.coalesce(r["controller"], F.lit(False))), F.lit(1)
    )
    use_controller = F.coalesce(controller["kind"], F.lit("")) != ""
    return promote(
        F.when(use_controller, controller["kind"]).otherwise(first["kind"]),
        F.when(use_controller, controller["name"]).otherwise(first["name"]),
    )
