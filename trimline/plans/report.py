"""From samples and pod specs to waste tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trimline.functions.clock import as_of_range
from trimline.operators.enrich import current_specs, enrich_series
from trimline.operators.series import series_keys, series_summary
from trimline.operators.waste import container_waste, pod_waste
from trimline.params import Tiering


def snapshots(samples: DataFrame, specs: DataFrame, t: Tiering) -> DataFrame:
    """Summary, window and metadata per series.

    Specs are reduced to the last row per container, and metadata is joined to the summaries and not
    to the samples: the join is as small as the number of series.
    """
    return enrich_series(series_summary(samples, t), current_specs(specs))


def containers(samples: DataFrame, specs: DataFrame, t: Tiering) -> DataFrame:
    return container_waste(snapshots(samples, specs, t))


def pods(samples: DataFrame, specs: DataFrame, t: Tiering) -> DataFrame:
    """Pod totals.

    With a fixed clock a pod that was seen before it may have no retained data; it is listed with zeros
    and the owner that its spec names. Pods first seen after the clock are not listed.
    """
    if t.as_of is None:
        return pod_waste(containers(samples, specs, t))
    owners = (
        current_specs(specs)
        .groupBy("pod_namespace", "pod_name")
        .agg(F.max(F.struct("owner_kind", "owner_name")).alias("owner"))
        .select("pod_namespace", "pod_name", "owner.*")
    )
    seen = series_keys(samples.filter(as_of_range(samples, t.as_of)))
    return pod_waste(containers(samples, specs, t), seen, owners)
