"""Registered queries: every operator over the driver's tables.

The fixture tables are sparse, so the bucket queries use wide granularities: with them all four
fates of a sample (live, fine, coarse, expired) occur and percentiles differ from maxima.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trimline.functions import text
from trimline.functions.owners import promote
from trimline.functions.quantities import cpu_millis, format_cpu, format_memory, memory_bytes
from trimline.operators import buckets, changes, counters, enrich, features, gitops, manifests
from trimline.operators import recommend, rollups, series, waste
from trimline.operators.percentiles import metric_aggregate
from trimline.params import EXACT, INCREMENTAL, Sizing, Tiering
from trimline.plans import report, rightsize, views
from trimline.schemas import METRICS, POD_LIST_DOCUMENT, SERIES, SPEC_KEY, USAGE_DOCUMENT
from trimline.scratch import place, written
from trimline.sources import bronze, kubelet, reports
from trimline.sources import gitops as gitops_documents
from trimline.streaming.buckets import (
    coarse_stream,
    fine_stream,
    read_buckets,
    read_ranked,
    read_rollup,
    start_buckets,
    start_rollup,
    value_stream,
)
from trimline.streaming.ingest import start_ingest
from trimline.streaming.reports import start_reports
from trimline.streaming.silver import (
    publish_silver,
    read_published,
    read_silver,
    start_partial_silver,
    start_silver,
    summary_from_silver,
)
from trimline.streaming.snapshots import newest
from trimline.streaming.specs import start_specs
from verification.fixtures import VIEWS, sql, view

HOUR, DAY = 3600, 86_400
EXACT_TIERS = Tiering(HOUR, 12 * HOUR, 7 * DAY, DAY, 21 * DAY, EXACT)
INCREMENTAL_TIERS = replace(EXACT_TIERS, mode=INCREMENTAL)
CLOCK = datetime(2024, 1, 28, 12, 0, 0)
FIXED_CLOCK = replace(EXACT_TIERS, as_of=CLOCK)
FIXED_CLOCK_INCREMENTAL = replace(FIXED_CLOCK, mode=INCREMENTAL)
# thresholds under which the fixture shows every pattern
SIZES = Sizing(
    step_seconds=12 * HOUR,
    idle_cpu_millis=500.0,
    growth_share=0.5,
    growth_min_steps=20,
    burst_peak_ratio=6.5,
    burst_variation=0.75,
)
DOMAIN = "sizing.example"
CREATED_AT = "2024-02-01 10:20:30"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        return run

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round doubles: sums of doubles depend on the order of rows."""
    return df.select(
        *[
            F.round(c, places).alias(c) if kind == "double" else F.col(c)
            for c, kind in df.dtypes
        ]
    )


def dense(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_dense")


def _containers(spark: SparkSession, sf: str, t: Tiering = EXACT_TIERS) -> DataFrame:
    samples, specs = view(spark, sf, "fx_samples"), view(spark, sf, "fx_pod_specs")
    return report.containers(samples, specs, t)


def _pods(spark: SparkSession, sf: str) -> DataFrame:
    return waste.pod_waste(_containers(spark, sf))


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    samples, specs = view(spark, sf, "fx_samples"), view(spark, sf, "fx_pod_specs")
    return rightsize.profile(samples, specs, EXACT_TIERS, SIZES)


def _patterns(spark: SparkSession, sf: str) -> DataFrame:
    return features.classify(features.features(_profile(spark, sf)), SIZES)


def _recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return recommend.recommendations(_patterns(spark, sf), SIZES)


# --- series and buckets ---------------------------------------------------------------------


@query("series_keys")
def _(spark, sf):
    keys = series.series_keys(view(spark, sf, "fx_samples"))
    key = text.series_key(F.col("pod_namespace"), F.col("pod_name"), F.col("container_name"))
    parts = text.split_series_key(key)
    return keys.select(
        "node_name",
        key.alias("series_key"),
        parts["pod_namespace"].alias("pod_namespace"),
        parts["pod_name"].alias("pod_name"),
        parts["container_name"].alias("container_name"),
    )


@query("metric_aggregate")
def _(spark, sf):
    items = sql(spark, sf, "SELECT l_suppkey, l_extendedprice FROM lineitem")
    return metric_aggregate(items, ["l_suppkey"], {"l_extendedprice": "price"})


@query("metric_aggregate_split")
def _(spark, sf):
    # every group above 500 rows takes the path for large groups
    items = sql(spark, sf, "SELECT l_returnflag, l_extendedprice, l_quantity FROM lineitem")
    values = {"l_extendedprice": "price", "l_quantity": "quantity"}
    return metric_aggregate(items, ["l_returnflag"], values, hot_rows=500)


@query("tier_counts")
def _(spark, sf):
    return buckets.tier_counts(dense(spark, sf), EXACT_TIERS)


def _buckets(spark: SparkSession, sf: str, t: Tiering, tier: str | None = None) -> DataFrame:
    rows = buckets.buckets(dense(spark, sf), t)
    return rounded(rows if tier is None else rows.filter(F.col("tier") == tier), 3)


QUERIES["buckets_fine_exact"] = lambda spark, sf: _buckets(spark, sf, EXACT_TIERS, "fine")
QUERIES["buckets_fine_incremental"] = lambda spark, sf: _buckets(
    spark, sf, INCREMENTAL_TIERS, "fine"
)
QUERIES["buckets_coarse"] = lambda spark, sf: _buckets(spark, sf, EXACT_TIERS, "coarse")
QUERIES["buckets_all"] = lambda spark, sf: _buckets(spark, sf, INCREMENTAL_TIERS)


def _summary(spark: SparkSession, sf: str, t: Tiering) -> DataFrame:
    summary = series.series_summary(dense(spark, sf), t)
    return rounded(summary.drop("data_window_ns", "window_start", "window_end"), 3)


QUERIES["series_summary_exact"] = lambda spark, sf: _summary(spark, sf, EXACT_TIERS)
QUERIES["series_summary_incremental"] = lambda spark, sf: _summary(spark, sf, INCREMENTAL_TIERS)
QUERIES["series_summary_fixed_clock"] = lambda spark, sf: _summary(spark, sf, FIXED_CLOCK)
QUERIES["series_summary_fixed_clock_incremental"] = lambda spark, sf: _summary(
    spark, sf, FIXED_CLOCK_INCREMENTAL
)
QUERIES["series_summary_hot"] = lambda spark, sf: _summary(
    spark, sf, replace(EXACT_TIERS, hot_rows=100, hot_bucket_rows=30)
)


@query("data_window")
def _(spark, sf):
    samples = view(spark, sf, "fx_samples")
    return series.series_summary(samples, INCREMENTAL_TIERS).select(
        *SERIES, "window_start", "window_end", "data_window_ns"
    )


@query("series_meta")
def _(spark, sf):
    return series.latest_metadata(view(spark, sf, "fx_annotated"))


# --- joins and scalar functions -------------------------------------------------------------


@query("samples_enriched")
def _(spark, sf):
    specs = enrich.parse_specs(view(spark, sf, "fx_pod_specs"))
    return enrich.enrich_samples(view(spark, sf, "fx_samples"), specs)


@query("samples_enriched_same_scrape")
def _(spark, sf):
    """Every second sample has a pod list of its own scrape."""
    samples = view(spark, sf, "fx_samples").withColumn("scraped_at", F.col("ts"))
    scraped = samples.filter("seq % 2 = 0").select(*SPEC_KEY, "scraped_at", (F.col("seq") % 900).cast("bigint").alias("cpu_request_millis"))
    scraped = scraped.groupBy(*SPEC_KEY, "scraped_at").agg(F.max("cpu_request_millis").alias("cpu_request_millis"))
    found = enrich.enrich_samples(samples, scraped, same_scrape=True)
    return found.select(*SERIES, "ts", "seq", "cpu_nano", "cpu_request_millis")


@query("samples_enriched_as_of")
def _(spark, sf):
    samples = view(spark, sf, "fx_samples").select(*SERIES, "ts", "seq", "cpu_nano")
    return enrich.enrich_as_of(samples, view(spark, sf, "fx_spec_changes"))


@query("parse_quantities")
def _(spark, sf):
    texts = """
SELECT p_partkey,
       CASE p_partkey % 6 WHEN 0 THEN concat(cast(p_size AS string), 'm')
            WHEN 1 THEN cast(p_retailprice AS string) WHEN 2 THEN concat('  ', cast(p_size AS string), ' ')
            WHEN 3 THEN concat('-', cast(p_size AS string), '.5m') WHEN 4 THEN p_name ELSE concat(cast(p_size AS string), 'M') END AS cpu_text,
       CASE p_partkey % 8 WHEN 0 THEN concat(cast(p_size AS string), 'Mi')
            WHEN 1 THEN concat(cast(p_retailprice AS string), 'Ki') WHEN 2 THEN concat(' ', cast(p_size AS string), 'k ')
            WHEN 3 THEN concat(cast(p_size AS string), '.25Gi') WHEN 4 THEN p_type WHEN 5 THEN concat('-', cast(p_size AS string), 'M')
            WHEN 6 THEN concat(cast(p_size AS string), 'd') ELSE cast(p_size * 1003 AS string) END AS mem_text
FROM part"""
    return sql(spark, sf, texts).select(
        "p_partkey",
        cpu_millis(F.col("cpu_text")).alias("cpu_millis"),
        memory_bytes(F.col("mem_text")).alias("memory_bytes"),
    )


@query("formatted_quantities")
def _(spark, sf):
    sizes = "SELECT o_orderkey, o_custkey, cast(round(o_totalprice * 1048576 / 50) AS bigint) AS size FROM orders"
    return sql(spark, sf, sizes).select(
        "o_orderkey",
        format_cpu(F.col("o_custkey") * 50).alias("cpu"),
        format_memory(F.col("size")).alias("memory"),
        format_memory(F.col("o_custkey") * 268_435_456).alias("memory_blocks"),
    )


@query("owner_names")
def _(spark, sf):
    owner = promote(F.col("owner_kind"), F.col("owner_name"))
    return view(spark, sf, "fx_pod_specs").select(
        "pod_namespace", "pod_name", owner["kind"].alias("kind"), owner["name"].alias("name")
    )


@query("usage_documents")
def _(spark, sf):
    """Build one usage document per sample and flatten it again; every third has no CPU part."""
    cpu = F.when(
        F.col("seq") % 3 != 0, F.struct(F.col("cpu_nano").cast("decimal(20,0)").alias("usageNanoCores"))
    )
    container = F.struct(
        F.col("container_name").alias("name"),
        cpu.alias("cpu"),
        F.struct(F.col("mem_usage").alias("usageBytes"), F.col("mem_ws").alias("workingSetBytes")).alias("memory"),
    )
    pod = F.struct(
        F.struct(F.col("pod_name").alias("name"), F.col("pod_namespace").alias("namespace")).alias("podRef"),
        F.array(container).alias("containers"),
    )
    document = F.to_json(
        F.struct(F.struct(F.col("node_name").alias("nodeName")).alias("node"), F.array(pod).alias("pods"))
    )
    landed = view(spark, sf, "fx_samples").select("ts", "seq", document.alias("body"))
    parsed = landed.select(
        F.col("ts").alias("scraped_at"), "seq", F.from_json("body", USAGE_DOCUMENT).alias("d")
    ).select("scraped_at", "seq", "d.*")
    return kubelet.usage_samples(parsed).withColumns(
        {c: F.col(c).cast("bigint") for c in ("cpu_nano", "mem_usage", "mem_ws")}
    )


@query("pod_documents")
def _(spark, sf):
    """Build one pod list per pod spec and flatten it again."""
    def quantities(kind: str) -> Column:
        return F.struct(F.col(f"cpu_{kind}").alias("cpu"), F.col(f"mem_{kind}").alias("memory"))

    reference = F.struct(
        F.col("owner_kind").alias("kind"), F.col("owner_name").alias("name"), F.lit(True).alias("controller")
    )
    other = F.struct(F.lit("Node").alias("kind"), F.lit("n1").alias("name"), F.lit(False).alias("controller"))
    # the status names the container twice; the last entry counts
    status = F.array(
        F.struct(F.col("container_name").alias("name"), F.lit(99).alias("restartCount")),
        F.struct(F.col("container_name").alias("name"), F.col("restart_count").alias("restartCount")),
    )
    item = F.struct(
        F.struct(
            F.col("pod_name").alias("name"),
            F.col("pod_namespace").alias("namespace"),
            F.when(F.col("owner_kind") != "", F.array(other, reference)).alias("ownerReferences"),
        ).alias("metadata"),
        F.struct(
            F.array(
                F.struct(
                    F.col("container_name").alias("name"),
                    F.struct(quantities("request").alias("requests"), quantities("limit").alias("limits")).alias("resources"),
                )
            ).alias("containers")
        ).alias("spec"),
        F.struct(F.col("qos_class").alias("qosClass"), status.alias("containerStatuses")).alias("status"),
    )
    bodies = view(spark, sf, "fx_pod_specs").select(F.to_json(F.struct(F.array(item).alias("items"))).alias("body"))
    parsed = bodies.select(
        F.lit(CREATED_AT).cast("timestamp").alias("scraped_at"),
        F.lit(0).cast("bigint").alias("seq"),
        F.from_json("body", POD_LIST_DOCUMENT).alias("d"),
    ).select("scraped_at", "seq", "d.*")
    return kubelet.pod_specs(parsed).drop("scraped_at", "seq")


# --- waste and roll-ups ---------------------------------------------------------------------


@query("container_waste")
def _(spark, sf):
    return rounded(_containers(spark, sf), 3)


@query("pod_waste")
def _(spark, sf):
    return rounded(_pods(spark, sf))


def _pods_at_clock(spark: SparkSession, sf: str, samples: str) -> DataFrame:
    # two days of retention, so that some pods have nothing left and are listed with zeros
    t = replace(FIXED_CLOCK, fine_keep_seconds=DAY, coarse_keep_seconds=2 * DAY)
    return report.pods(view(spark, sf, samples), view(spark, sf, "fx_pod_specs"), t)


@query("pod_waste_fixed_clock")
def _(spark, sf):
    return rounded(_pods_at_clock(spark, sf, "fx_samples"))


@query("workloads_fixed_clock")
def _(spark, sf):
    return rounded(rollups.workloads(_pods_at_clock(spark, sf, "fx_late_pods")))


@query("cluster_table_fixed_clock")
def _(spark, sf):
    return views.cluster_table(_pods_at_clock(spark, sf, "fx_late_pods"))


@query("node_waste")
def _(spark, sf):
    return rounded(waste.node_waste(_pods(spark, sf)))


@query("workloads")
def _(spark, sf):
    return rounded(rollups.workloads(_pods(spark, sf)))


@query("workload_usage")
def _(spark, sf):
    samples, specs = view(spark, sf, "fx_samples"), view(spark, sf, "fx_pod_specs")
    return rounded(rollups.workload_usage(report.snapshots(samples, specs, EXACT_TIERS)), 3)


@query("cluster_table")
def _(spark, sf):
    return views.cluster_table(_pods(spark, sf))


@query("cluster_totals")
def _(spark, sf):
    return rounded(rollups.cluster(_pods(spark, sf)))


@query("waste_grouping_sets")
def _(spark, sf):
    return rounded(rollups.all_levels(_pods(spark, sf)))


@query("namespace_table")
def _(spark, sf):
    return views.namespace_table(_pods(spark, sf), "ns-1")


@query("workloads_table")
def _(spark, sf):
    return views.workloads_table(_pods(spark, sf))


@query("workload_detail")
def _(spark, sf):
    return views.workload_detail(_containers(spark, sf))


@query("top_workloads")
def _(spark, sf):
    return rounded(views.top_workloads(_pods(spark, sf), 5))


@query("top_workloads_by_namespace")
def _(spark, sf):
    return rounded(views.top_workloads_by_namespace(_pods(spark, sf), 2))


@query("waste_by_namespace")
def _(spark, sf):
    return rounded(views.waste_by_namespace(_pods(spark, sf)))


@query("latest_node_reports")
def _(spark, sf):
    return reports.latest_per_node(view(spark, sf, "fx_node_reports"))


@query("node_report_totals")
def _(spark, sf):
    return rounded(reports.cluster_totals(reports.latest_per_node(view(spark, sf, "fx_node_reports"))), 0)


@query("node_report_documents")
def _(spark, sf):
    """Lines of nodes and pods, read back from their JSON text."""
    documents = reports.node_report_documents(_containers(spark, sf), CREATED_AT)
    pod = "struct<podName:string,podNamespace:string,ownerRef:struct<kind:string,name:string>,totalCpuWasteMillis:double>"
    fields = f"nodeName string, reportTime string, pod {pod}, podCount bigint, totalMemWasteBytes double"
    parsed = documents.select("kind", F.from_json("document", fields).alias("d")).select("kind", "d.*")
    nodes = parsed.filter("kind = 'node'").select("nodeName", "podCount", "totalMemWasteBytes")
    pods = parsed.filter("kind = 'pod'").select("nodeName", "reportTime", F.col("pod").alias("p"))
    return rounded(
        pods.join(nodes, "nodeName").select(
            F.col("nodeName").alias("node_name"),
            F.col("reportTime").alias("report_time"),
            F.col("p.podNamespace").alias("pod_namespace"),
            F.col("p.podName").alias("pod_name"),
            F.col("p.ownerRef.name").alias("owner_name"),
            F.col("p.totalCpuWasteMillis").alias("pod_cpu_waste"),
            F.col("podCount").alias("node_pods"),
            F.col("totalMemWasteBytes").alias("node_mem_waste"),
        ),
        4,
    )


@query("cluster_report_documents")
def _(spark, sf):
    """Lines of the cluster, its owners and pods, read back from their JSON text."""
    documents = reports.cluster_report_documents(_containers(spark, sf), CREATED_AT)
    pod = "struct<podName:string,containers:array<struct<containerName:string,cpuWasteMillis:double>>>"
    fields = f"nodeCount bigint, podCount bigint, namespace string, owner struct<kind:string,name:string>, pod {pod}"
    parsed = documents.select("kind", F.from_json("document", fields).alias("d")).select("kind", "d.*")
    key = ["namespace", "owner"]
    total = parsed.filter("kind = 'cluster'").select("nodeCount", F.col("podCount").alias("allPods"))
    owners = parsed.filter("kind = 'owner'").select(*key, "podCount")
    rows = parsed.filter("kind = 'pod'").select(*key, F.explode("pod.containers").alias("c"))
    sums = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("containers"), F.sum("c.cpuWasteMillis").alias("cpu_waste_millis")
    )
    return rounded(
        owners.join(sums, key).select(
            F.col("namespace").alias("pod_namespace"),
            F.col("owner.kind").alias("owner_kind"),
            F.col("owner.name").alias("owner_name"),
            F.col("podCount").alias("owner_pods"),
            total.select("nodeCount").scalar().alias("node_count"),
            total.select("allPods").scalar().alias("pod_count"),
            "containers",
            "cpu_waste_millis",
        ),
        4,
    )


@query("cluster_report_recommendations")
def _(spark, sf):
    """The recommendations inside the cluster report."""
    documents = reports.cluster_report_documents(_containers(spark, sf), CREATED_AT, _recommendations(spark, sf))
    fields = "recommendation struct<target:struct<kind:string,name:string,namespace:string>,container:string,resource:string,recommendedRequest:bigint,risk:string>"
    found = documents.filter("kind = 'recommendation'").select("pod_namespace", F.from_json("document", fields)["recommendation"].alias("r"))
    return found.select(
        "pod_namespace",
        F.concat_ws("/", "r.target.kind", "r.target.name").alias("target"),
        F.col("r.container").alias("container_name"),
        "r.resource",
        F.col("r.recommendedRequest").alias("recommended_request"),
        "r.risk",
    )


@query("envelopes")
def _(spark, sf):
    """Wrap orders into ok and error envelopes, then unwrap them again."""
    orders = sql(spark, sf, "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
    at = F.col("o_orderdate").cast("timestamp")
    data = F.struct("o_orderkey", "o_totalprice")
    body = F.when(
        F.col("o_orderstatus") == "F", reports.error_envelope(F.concat(F.lit("order "), F.col("o_orderkey")), at)
    ).otherwise(reports.ok_envelope(data, at))
    kind = orders.select(data.alias("d")).schema["d"].dataType
    good, bad = reports.decode_envelopes(orders.select("o_orderkey", body.alias("body")), kind)
    return good.select("o_orderkey", F.col("data.o_totalprice").alias("total"), "timestamp", F.lit(None).cast("string").alias("error")).unionByName(
        bad.select("o_orderkey", F.lit(None).cast("double").alias("total"), F.lit(None).cast("string").alias("timestamp"), "error")
    )


# --- patterns and recommendations -----------------------------------------------------------


@query("patterns")
def _(spark, sf):
    kept = [*features.WORKLOAD_CONTAINER, "pattern", "n", "steps", "idle_seconds", "idle_share",
            "variation", "peak_ratio", "cpu_p50", "cpu_p95", "ws_p99", "data_window_ns"]
    return rounded(_patterns(spark, sf).select(*kept), 4)


@query("idle_runs")
def _(spark, sf):
    runs = features.idle_runs(_profile(spark, sf))
    return runs.withColumn("run_start", F.timestamp_micros("run_start_us").cast("timestamp_ntz")).drop("run_start_us")


@query("memory_growth")
def _(spark, sf):
    return rounded(features.memory_growth(_profile(spark, sf)), 4)


@query("recommendations")
def _(spark, sf):
    return _recommendations(spark, sf)


@query("recommendations_filtered")
def _(spark, sf):
    return recommend.filter_recommendations(_recommendations(spark, sf), risk="medium", namespace="ns-2")


@query("recommendations_ranked")
def _(spark, sf):
    return views.recommendations_table(recommend.by_savings(_recommendations(spark, sf)))


@query("recommendations_by_confidence")
def _(spark, sf):
    return views.recommendations_table(recommend.by_confidence(_recommendations(spark, sf)))


@query("savings_by_resource")
def _(spark, sf):
    return recommend.savings_by_resource(_recommendations(spark, sf))


_BY_CONTAINER = ["container_name", "resource"]


@query("one_per_target")
def _(spark, sf):
    return recommend.one_per_target(_recommendations(spark, sf), _BY_CONTAINER)


@query("change_body")
def _(spark, sf):
    texts = changes.with_texts(_recommendations(spark, sf))
    return texts.select(*rollups.OWNER, "container_name", "resource", "title", "body")


# recommendation rows as they arrive over time, one per event
FX_RECOMMENDATIONS = """
SELECT concat('ns-', cast(user_id % 6 AS string)) AS pod_namespace, 'Deployment' AS owner_kind,
       concat('app-', cast(user_id % 30 AS string)) AS owner_name, 'main' AS container_name,
       CASE WHEN event_id % 2 = 0 THEN 'cpu' ELSE 'memory' END AS resource,
       CASE event_type WHEN 'error' THEN 'idle' WHEN 'click' THEN 'steady' ELSE 'burstable' END AS pattern,
       cast(round(value * 10) AS bigint) - 200 AS est_savings, ts, event_id AS seq
FROM events"""


@query("digest")
def _(spark, sf):
    found = recommend.digest(sql(spark, sf, FX_RECOMMENDATIONS), "optimisation", 6 * HOUR)
    return found.withColumn("digest_start", F.col("digest_start").cast("timestamp_ntz"))


# --- mappings and change requests -----------------------------------------------------------


def _mappings(spark: SparkSession, sf: str) -> DataFrame:
    flux = gitops.flux_mappings(view(spark, sf, "fx_flux_inventory"), view(spark, sf, "fx_git_repos"))
    return gitops.all_mappings(gitops.argo_mappings(view(spark, sf, "fx_argo_resources")), flux)


@query("flux_mappings")
def _(spark, sf):
    return gitops.flux_mappings(view(spark, sf, "fx_flux_inventory"), view(spark, sf, "fx_git_repos"))


@query("mappings")
def _(spark, sf):
    return _mappings(spark, sf)


@query("annotate_commands")
def _(spark, sf):
    commands = gitops.annotate_commands(_mappings(spark, sf), "trimline")
    return commands.select("display", F.size("args").cast("bigint").alias("n_args"), F.try_element_at("args", F.lit(2)).alias("target"))


FX_REQUESTS = """
SELECT p_partkey,
       CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN concat('/', p_name) ELSE concat('deployment/', p_brand) END AS target,
       CASE p_partkey % 3 WHEN 0 THEN '' ELSE concat('ns-', cast(p_size AS string)) END AS namespace,
       CASE p_partkey % 11 WHEN 0 THEN '' WHEN 1 THEN '-x' ELSE 'git.example/manifests' END AS repo,
       CASE p_partkey % 13 WHEN 0 THEN '' ELSE concat('apps/', p_type) END AS path,
       CASE p_partkey % 5 WHEN 0 THEN '-f' WHEN 1 THEN 'resources' ELSE '' END AS field
FROM part"""


@query("annotation_arguments")
def _(spark, sf):
    checked = gitops.annotation_arguments(sql(spark, sf, FX_REQUESTS), DOMAIN)
    return checked.select("p_partkey", "error", F.array_join("args", " ").alias("arguments"))


FX_PATHS = """
SELECT o_orderkey,
       CASE o_custkey % 6 WHEN 0 THEN 'apps/../x' WHEN 1 THEN '../x' WHEN 2 THEN 'a/../../b'
            WHEN 3 THEN '.' WHEN 4 THEN concat('apps/', cast(o_custkey AS string), '/values.yaml') ELSE 'a/./b//c/../d' END AS path
FROM orders"""


@query("path_escapes")
def _(spark, sf):
    return sql(spark, sf, FX_PATHS).select("o_orderkey", text.escapes_root(F.col("path")).alias("escapes"))


FX_ANNOTATED_WORKLOADS = """
SELECT DISTINCT concat('ns-', cast(user_id % 6 AS string)) AS namespace, 'Deployment' AS kind,
       concat('app-', cast(user_id % 30 AS string)) AS name,
       CASE user_id % 30 % 4
         WHEN 0 THEN concat('{"sizing.example/repo": "git.example/r', cast(user_id % 30 AS string), '"}')
         ELSE concat('{"sizing.example/repo": "git.example/r', cast(user_id % 30 AS string), '", "sizing.example/path": "apps/app-',
                     cast(user_id % 30 AS string), CASE WHEN user_id % 30 % 2 = 0 THEN '/values.yaml' ELSE '/deploy.yaml' END, '", "sizing.example/field": "resources"}') END AS annotations
FROM events"""


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    return gitops.read_annotations(sql(spark, sf, FX_ANNOTATED_WORKLOADS), DOMAIN)


@query("source_annotations")
def _(spark, sf):
    return _sources(spark, sf).drop("annotations")


def _change_requests(spark: SparkSession, sf: str) -> DataFrame:
    sources = _sources(spark, sf).drop("annotations")
    return changes.change_requests(_recommendations(spark, sf), sources, _BY_CONTAINER, CREATED_AT)


@query("change_requests")
def _(spark, sf):
    return _change_requests(spark, sf).select(
        *rollups.OWNER, "container_name", "resource", "title", "branch", "repo", "path", "field", "error", "body"
    )


# one manifest per part: plain, quoted, fractional or missing CPU values
FX_MANIFESTS = r"""
SELECT p_partkey, concat('apps/', cast(p_partkey AS string), '/deploy.yaml') AS path, '' AS field,
       CASE WHEN p_partkey % 2 = 0 THEN 'cpu' ELSE 'memory' END AS resource,
       cast(p_size * 10 AS bigint) AS recommended_request,
       CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE cast(p_size AS bigint) * 50000000 END AS recommended_limit,
       CASE p_partkey % 5 WHEN 0 THEN '500m' WHEN 1 THEN '"2"' WHEN 2 THEN '0.5' ELSE '1000m' END AS cpu_value,
       CASE p_partkey % 7 WHEN 0 THEN '"512Mi"' WHEN 1 THEN '134217728' ELSE '2Gi' END AS mem_value
FROM part"""
_MANIFEST = "kind: Deployment\nspec:\n  resources:\n    requests:\n      cpu: %s\n      memory: %s\n    limits:\n      cpu: %s # max\n      memory: %s\nend: 1"


@query("manifest_edits")
def _(spark, sf):
    values = sql(spark, sf, FX_MANIFESTS)
    cpu, mem = F.col("cpu_value"), F.col("mem_value")
    files = values.withColumn("content", F.format_string(_MANIFEST, cpu, mem, cpu, mem))
    return manifests.edit_manifests(files).select("p_partkey", "resource", "new_content", "changed", "error")


@query("manifest_edits_joined")
def _(spark, sf):
    """Files of the change requests, joined on repository and path and edited."""
    sources = _sources(spark, sf).filter(F.col("annotation_error").isNull())
    files = sources.select("repo", "path", F.lit(_MANIFEST % ("1", "1Gi", "2", "2Gi")).alias("content"))
    edits = changes.manifest_edits(_change_requests(spark, sf), files)
    return manifests.edit_manifests(edits).select("repo", "path", "resource", "new_content", "changed", "error")


# --- counters -------------------------------------------------------------------------------

_LABELS = ["label_from", "label_to"]


@query("counter_rate")
def _(spark, sf):
    return rounded(counters.counter_rate(view(spark, sf, "fx_counters"), _LABELS, HOUR, 300))


@query("counter_increase")
def _(spark, sf):
    return rounded(counters.counter_increase(view(spark, sf, "fx_counters"), _LABELS, DAY))


@query("increase_by_labels")
def _(spark, sf):
    """Kept metrics only; series that differ in the other label are added up."""
    kept = counters.keep_metrics(view(spark, sf, "fx_counters"), counters.KEPT_METRICS)
    return rounded(counters.total_by_labels(kept, _LABELS, ["label_to"], DAY))


@query("latest_gauge")
def _(spark, sf):
    return counters.latest_gauge(view(spark, sf, "fx_counters"), _LABELS)


# --- streams over the events table, run until all of it is read ------------------------------

STREAM_TIERS = replace(INCREMENTAL_TIERS, fine_seconds=6 * HOUR)
SILVER_TIERS = replace(
    INCREMENTAL_TIERS, as_of=datetime(2024, 1, 29, 0, 0, 0), raw_seconds=12 * HOUR
)


def _dense_stream(spark: SparkSession, sf: str, batches: int = 1) -> DataFrame:
    """The samples as a stream; with several ``batches``, rewritten in as many files by the hash of the event."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.read.parquet(f"{sf}/events.parquet")
    name = f"events_{uuid.uuid4().hex}"
    # as a glob the path may be one file or a folder of files
    path, reader = f"{sf}/events.parque[t]", spark.readStream.schema(events.schema)
    if batches > 1:
        path = place(spark, "events")
        events.repartition(batches, F.pmod(F.xxhash64("event_id"), F.lit(batches))).write.parquet(path)
        reader = reader.option("maxFilesPerTrigger", 1)
    stream = reader.parquet(path)
    stream.createOrReplaceTempView(name)
    samples = spark.sql(VIEWS["fx_dense"].replace("FROM events", f"FROM {name}"))
    spark.catalog.dropTempView(name)
    return samples


def _kept_buckets(spark: SparkSession, sf: str, t: Tiering) -> DataFrame:
    """Fine buckets, closed and open, after the stream has read all of the input."""
    folder = place(spark, "stream")
    stream = fine_stream(_dense_stream(spark, sf), t)
    start_buckets(stream, f"{folder}/buckets", f"{folder}/checkpoint", None).awaitTermination()
    return read_buckets(spark, f"{folder}/buckets")


def _shown_buckets(found: DataFrame) -> DataFrame:
    columns = [*SERIES, F.col("bucket_start").cast("timestamp_ntz").alias("bucket_start"), F.col("n").alias("sample_count")]
    return rounded(found.select(*columns, *[f"cpu_{k}" for k in ("p50", "p95", "p99", "max")]), 3)


@query("stream_fine_buckets")
def _(spark, sf):
    return _shown_buckets(_kept_buckets(spark, sf, STREAM_TIERS))


@query("stream_fine_buckets_exact")
def _(spark, sf):
    """Exact ranks from counted values as state."""
    folder, t = place(spark, "stream"), replace(STREAM_TIERS, mode=EXACT)
    stream = value_stream(_dense_stream(spark, sf), t)
    start_buckets(stream, f"{folder}/values", f"{folder}/checkpoint", None).awaitTermination()
    return _shown_buckets(read_ranked(spark, f"{folder}/values"))


@query("stream_coarse_buckets")
def _(spark, sf):
    """Coarse buckets, closed and open, kept by the stream over three batches of fine ones."""
    folder = place(spark, "rollup")
    fine = fine_stream(_dense_stream(spark, sf, 3), STREAM_TIERS)
    start_rollup(fine, f"{folder}/fine", f"{folder}/coarse", f"{folder}/checkpoint", STREAM_TIERS, None).awaitTermination()
    return _shown_buckets(read_rollup(spark, f"{folder}/coarse"))


@query("stream_coarse_closed")
def _(spark, sf):
    """Coarse buckets chained on fine ones as a second stateful operator: those that the watermark has closed."""
    folder, name = place(spark, "chained"), f"chained_{uuid.uuid4().hex}"
    hourly = coarse_stream(fine_stream(_dense_stream(spark, sf), STREAM_TIERS, "1 day"), STREAM_TIERS)
    (
        hourly.writeStream.outputMode("append").format("parquet").queryName(name).trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/coarse").start().awaitTermination()
    )
    found = spark.read.parquet(f"{folder}/coarse").withColumn("bucket_start", F.col("w.start"))
    return _shown_buckets(found)


@query("silver_summary")
def _(spark, sf):
    """Summary from a streamed silver table and the live tail of the samples."""
    folder = place(spark, "silver")
    start_partial_silver(
        _dense_stream(spark, sf), f"{folder}/silver", f"{folder}/checkpoint", SILVER_TIERS, None
    ).awaitTermination()
    silver = read_silver(spark, f"{folder}/silver", SILVER_TIERS)
    return rounded(
        summary_from_silver(silver, dense(spark, sf), SILVER_TIERS).drop("window_start", "window_end"), 3
    )


@query("silver_published")
def _(spark, sf):
    """Silver rows compacted and evicted twice, each time as one version; the second one is read."""
    folder, t = place(spark, "published"), replace(SILVER_TIERS, as_of=None)
    start_partial_silver(_dense_stream(spark, sf, 3), f"{folder}/silver", f"{folder}/checkpoint", t, None).awaitTermination()
    for version, day in enumerate(("2024-01-05", "2024-01-20")):
        publish_silver(spark, f"{folder}/silver", f"{folder}/table", t, version, day)
    found = read_published(spark, f"{folder}/table")
    columns = [*SERIES, F.timestamp_micros("bucket_us").cast("timestamp_ntz").alias("bucket_start"), F.col("n").alias("sample_count")]
    return rounded(found.select(*columns, *[f"cpu_{k}" for k in ("p50", "p95", "p99", "max")]), 3)


@query("silver_exact_summary")
def _(spark, sf):
    """The same from bronze, with exact buckets recomputed for every batch."""
    folder, t = place(spark, "silver"), replace(SILVER_TIERS, mode=EXACT)
    bronze.write_samples(dense(spark, sf), f"{folder}/bronze")
    start_silver(spark, f"{folder}/bronze", f"{folder}/silver", f"{folder}/checkpoint", t, None).awaitTermination()
    silver = read_silver(spark, f"{folder}/silver", t)
    tail = bronze.read_tail(spark, f"{folder}/bronze", t)
    return rounded(summary_from_silver(silver, tail, t).drop("window_start", "window_end"), 3)


def _periodic_report(spark: SparkSession, sf: str) -> str:
    """Run the report stream over a bronze table of enriched samples; the path of the reports."""
    folder = place(spark, "reports")
    specs = enrich.parse_specs(view(spark, sf, "fx_pod_specs"))
    enriched = written(enrich.enrich_samples(view(spark, sf, "fx_samples"), specs), "enriched")
    # three batches: all but late samples and the last days, then the late ones, then the rest
    late, last = F.col("seq") % 5 == 0, F.col("ts") >= F.lit("2024-01-25").cast("timestamp_ntz")
    for part in (~late & ~last, late & ~last, last):
        bronze.write_samples(enriched.filter(part), f"{folder}/bronze")
        start_reports(
            spark, f"{folder}/bronze", f"{folder}/reports", f"{folder}/checkpoint", EXACT_TIERS, None
        ).awaitTermination()
    return f"{folder}/reports"


@query("periodic_report")
def _(spark, sf):
    newest = reports.latest_per_node(spark.read.parquet(_periodic_report(spark, sf)).drop("batch_id"))
    return rounded(newest.drop("report_time", "seq"))


@query("periodic_report_pods")
def _(spark, sf):
    pods = spark.read.parquet(f"{_periodic_report(spark, sf)}-pods")
    return rounded(newest(pods, ["node_name"], ["seq"]).drop("report_time", "seq", "batch_id"))


def _usage_documents(samples: DataFrame) -> Column:
    """One usage document per sample, as JSON."""
    container = F.struct(
        F.col("container_name").alias("name"),
        F.struct(F.col("cpu_nano").cast("decimal(20,0)").alias("usageNanoCores")).alias("cpu"),
        F.struct(F.col("mem_usage").alias("usageBytes"), F.col("mem_ws").alias("workingSetBytes")).alias("memory"),
    )
    reference = F.struct(F.col("pod_name").alias("name"), F.col("pod_namespace").alias("namespace"))
    pod = F.struct(reference.alias("podRef"), F.array(container).alias("containers"))
    node = F.struct(F.col("node_name").alias("nodeName"))
    return F.to_json(F.struct(_scraped(), "seq", node.alias("node"), F.array(pod).alias("pods")))


def _scraped() -> Column:
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("scraped_at")


def _pod_documents(changes_: DataFrame) -> Column:
    """One pod list per spec change, as JSON."""
    requests = F.struct(
        F.concat(F.col("cpu_request_millis").cast("string"), F.lit("m")).alias("cpu"), F.col("mem_request_bytes").cast("string").alias("memory")
    )
    container = F.struct(F.col("container_name").alias("name"), F.struct(requests.alias("requests")).alias("resources"))
    metadata = F.struct(F.col("pod_name").alias("name"), F.col("pod_namespace").alias("namespace"))
    item = F.struct(metadata.alias("metadata"), F.struct(F.array(container).alias("containers")).alias("spec"))
    return F.to_json(F.struct(_scraped(), "seq", F.array(item).alias("items")))


@query("ingested_samples")
def _(spark, sf):
    """Landed usage documents, ingested into bronze with the specs that were valid at their time.

    Pod lists land in two parts, the second one earlier in time and so late.
    """
    folder = place(spark, "ingest")
    specs = view(spark, sf, "fx_spec_changes")
    for part in (F.col("seq") % 3 > 0, F.col("seq") % 3 == 0):
        specs.filter(part).select(_pod_documents(specs).alias("value")).write.mode("append").text(f"{folder}/pods")
        start_specs(spark, f"{folder}/pods", f"{folder}/specs", f"{folder}/specs-checkpoint", None, late_seconds=31 * DAY).awaitTermination()
    samples = view(spark, sf, "fx_samples")
    samples.select(_usage_documents(samples).alias("value")).write.text(f"{folder}/usage")
    start_ingest(
        spark, f"{folder}/usage", None, f"{folder}/bronze", f"{folder}/checkpoint", None, spec_table=f"{folder}/specs"
    ).awaitTermination()
    found = bronze.read_samples(spark, f"{folder}/bronze", EXACT_TIERS)
    return found.select(
        *SERIES, F.col("ts").cast("timestamp_ntz").alias("ts"), "seq", *[F.col(c).cast("bigint").alias(c) for c in METRICS],
        "cpu_request_millis", "mem_request_bytes",
    )


@query("rejected_documents")
def _(spark, sf):
    """Documents as landed, one in seven cut short: samples by node, and what was counted and kept as rejected."""
    folder = place(spark, "rejects")
    samples = view(spark, sf, "fx_samples")
    text_ = _usage_documents(samples)
    cut = F.when(F.col("seq") % 7 == 0, text_.substr(F.lit(1), F.length(text_) - 5)).otherwise(text_)
    samples.select(cut.alias("value")).write.text(f"{folder}/usage")
    start_ingest(
        spark, f"{folder}/usage", None, f"{folder}/bronze", f"{folder}/checkpoint", None, rejects_path=f"{folder}/rejects"
    ).awaitTermination()
    good = spark.read.parquet(f"{folder}/bronze").groupBy(F.col("node_name").alias("kind")).count()
    kept = spark.read.parquet(f"{folder}/rejects").groupBy(F.lit("kept").alias("kind")).count()
    counts = spark.read.parquet(f"{folder}/rejects-counts").agg(F.sum("landed").alias("landed"), F.sum("rejected").alias("rejected"))
    counted = counts.select(F.expr("stack(2, 'landed', landed, 'rejected', rejected) AS (kind, count)"))
    return good.unionByName(kept).unionByName(counted).withColumnRenamed("count", "n")


def _landed(rows: DataFrame, item: Column, label: str) -> str:
    """Write one list document per row, as a controller would hand them out; their folder."""
    folder = place(rows.sparkSession, label)
    rows.select(F.to_json(F.struct(F.array(item).alias("items"))).alias("value")).write.text(folder)
    return folder


@query("argo_documents")
def _(spark, sf):
    source = F.struct(F.col("repo_url").alias("repoURL"), "path").alias("source")
    status = F.struct(F.array(F.struct("kind", "name", "namespace")).alias("resources")).alias("status")
    item = F.struct(F.struct(source).alias("spec"), status)
    folder = _landed(view(spark, sf, "fx_argo_resources"), item, "argo")
    return gitops_documents.argo_resources(spark, folder, multi_line=False)


@query("flux_documents")
def _(spark, sf):
    reference = F.struct(F.col("source_name").alias("name"), F.col("source_namespace").alias("namespace"))
    spec = F.struct("path", reference.alias("sourceRef")).alias("spec")
    entries = F.array(F.struct(F.col("entry_id").alias("id"))).alias("entries")
    status = F.struct(F.struct(entries).alias("inventory")).alias("status")
    item = F.struct(F.struct(F.col("ks_namespace").alias("namespace")).alias("metadata"), spec, status)
    folder = _landed(view(spark, sf, "fx_flux_inventory"), item, "flux")
    return gitops_documents.flux_inventory(spark, folder, multi_line=False)


@query("repository_documents")
def _(spark, sf):
    item = F.struct(F.struct("name", "namespace").alias("metadata"), F.struct("url").alias("spec"))
    folder = _landed(view(spark, sf, "fx_git_repos"), item, "repositories")
    return gitops_documents.flux_repositories(spark, folder, multi_line=False)


@query("recommendation_documents")
def _(spark, sf):
    """Documents of all recommendations, written and read again."""
    folder = place(spark, "recommendations")
    reports.write_documents(reports.recommendation_documents(_recommendations(spark, sf)), folder)
    kind = (
        "target STRUCT<kind: STRING, name: STRING, namespace: STRING>, container STRING, resource STRING, "
        "currentRequest BIGINT, recommendedRequest BIGINT, recommendedLimit BIGINT, risk STRING, estimatedSavings BIGINT"
    )
    found = spark.read.schema(kind).json(folder)
    return found.select(
        F.concat_ws("/", "target.namespace", "target.kind", "target.name").alias("target"),
        F.col("container").alias("container_name"),
        "resource",
        F.col("currentRequest").alias("current_request"),
        F.col("recommendedRequest").alias("recommended_request"),
        F.col("recommendedLimit").alias("recommended_limit"),
        "risk",
        F.col("estimatedSavings").alias("est_savings"),
    )


@query("workload_rows")
def _(spark, sf):
    """Containers of one workload."""
    detail = views.workload_detail(_containers(spark, sf))
    return views.one_workload(detail, "ns-1", "Deployment", "app-1").select("pod_name", "container_name", "cpu_p95_millis", "mem_p95_mb")
