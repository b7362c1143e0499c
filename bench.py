"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query runs once to warm up and once timed, into a sink that discards the rows.
"""

from __future__ import annotations

import json
import os
import time

from trimline.session import local_session
from verification.queries import QUERIES

HEADLINE = (
    "container_waste",
    "cluster_table",
    "waste_grouping_sets",
    "recommendations",
    "series_summary_exact",
    "series_summary_incremental",
    "series_summary_fixed_clock",
    "series_summary_hot",
    "buckets_all",
    "series_meta",
    "metric_aggregate",
    "metric_aggregate_split",
    "samples_enriched",
    "counter_increase",
    "mappings",
    "change_requests",
    "manifest_edits",
)


def shuffled(spark) -> int:
    """Shuffle bytes written by all stages so far."""
    context = spark.sparkContext
    quantiles = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, quantiles, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(
        cpus,
        int(cpus) if cpus.isdigit() else 8,
        **{"spark.ui.retainedStages": "100000", "spark.ui.retainedJobs": "100000"},
    )

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds, shuffle_bytes = {}, {}
    for name in HEADLINE:
        run(name)
        before = shuffled(spark)
        seconds[name] = round(run(name), 3)
        shuffle_bytes[name] = shuffled(spark) - before
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "shuffle_bytes": shuffle_bytes,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
