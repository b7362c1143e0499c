import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.helpers import METADATA_DDL, T0, samples
from trimline.operators.enrich import enrich_as_of, enrich_samples, last_spec, parse_specs
from trimline.operators.rollups import all_levels, cluster, namespaces, workload_usage, workloads
from trimline.operators.series import latest_metadata, series_snapshot, series_summary
from trimline.operators.waste import container_waste, node_waste, pod_waste
from trimline.params import Tiering
from trimline.plans import report, views
from trimline.sources import reports

SPEC_DDL = (
    "pod_namespace string, pod_name string, container_name string, cpu_request string, cpu_limit string, "
    "mem_request string, mem_limit string, restart_count int, qos_class string, owner_kind string, owner_name string"
)


def enriched(spark, rows):
    """rows: (node, ns, pod, container, cpu_nano, ws, cpu_request, mem_request, qos, owner_kind, owner_name)"""
    ddl = (
        "node_name string, pod_namespace string, pod_name string, container_name string, ts timestamp_ntz, seq bigint, "
        "cpu_nano bigint, mem_usage bigint, mem_ws bigint, " + METADATA_DDL
    )
    data = [
        (n, ns, p, c, T0, i, cpu, 0, ws, cr, 0, mr, 0, 3, qos, ok, on)
        for i, (n, ns, p, c, cpu, ws, cr, mr, qos, ok, on) in enumerate(rows)
    ]
    return spark.createDataFrame(data, ddl)


def waste_of(samples_df):
    return container_waste(series_snapshot(series_summary(samples_df, Tiering()), latest_metadata(samples_df)))


API = [
    ("n1", "prod", "api-pod", "api", 500_000_000, 400_000_000, 2000, 1_000_000_000, "Burstable", "Deployment", "api"),
    ("n1", "prod", "api-pod", "sidecar", 10_000_000, 20_000_000, 200, 100_000_000, "", "", ""),
    ("n2", "prod", "api-pod2", "api", 300_000_000, 200_000_000, 2000, 1_000_000_000, "Burstable", "Deployment", "api"),
    ("n2", "dev", "lone", "app", 200_000_000, 150_000_000, 100, 100_000_000, "BestEffort", "", ""),
    ("n2", "dev", "free", "app", 100_000_000, 50_000_000, 0, 0, "BestEffort", "", ""),
]


def test_container_waste(spark):
    rows = {(r.pod_name, r.container_name): r for r in waste_of(enriched(spark, API)).collect()}
    api = rows[("api-pod", "api")]
    assert (api.cpu_waste_millis, api.cpu_waste_percent, api.mem_waste_bytes, api.mem_waste_percent) == (1500.0, 75.0, 6e8, 60.0)
    assert rows[("api-pod2", "api")].cpu_waste_millis == 1700.0
    over, unset = rows[("lone", "app")], rows[("free", "app")]
    assert (over.cpu_waste_millis, over.mem_waste_bytes) == (0.0, 0.0)
    assert (unset.cpu_waste_millis, unset.cpu_waste_percent, unset.mem_waste_bytes, unset.mem_waste_percent) == (0.0, 0.0, 0.0, 0.0)


def test_totals_agree_on_all_levels(spark):
    containers = waste_of(enriched(spark, API))
    pods = pod_waste(containers)
    first = {r.pod_name: r for r in pods.collect()}["api-pod"]
    assert (first.total_cpu_waste_millis, first.total_mem_waste_bytes, first.container_count) == (1690.0, 680_000_000.0, 2)
    assert (first.owner_kind, first.owner_name, first.qos_class) == ("Deployment", "api", "Burstable")
    total = cluster(pods).first()
    assert (total.node_count, total.pod_count, total.total_cpu_waste_millis) == (2, 4, 3390.0)
    for table in (node_waste(pods), workloads(pods), namespaces(pods)):
        assert table.agg(F.sum("total_cpu_waste_millis")).first()[0] == 3390.0
    owned = {(r.pod_namespace, r.owner_kind, r.owner_name): r.pod_count for r in workloads(pods).collect()}
    assert owned == {("prod", "Deployment", "api"): 2, ("dev", "Pod", "lone"): 1, ("dev", "Pod", "free"): 1}
    levels = {r["level"]: r["n"] for r in all_levels(pods).groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert levels == {"node": 2, "namespace": 2, "workload": 3, "cluster": 1}


def test_workload_usage_merges_pods(spark):
    frame = enriched(spark, API)
    usage = workload_usage(series_snapshot(series_summary(frame, Tiering()), latest_metadata(frame)))
    row = usage.filter("owner_name = 'api' and container_name = 'api'").first()
    assert (row.n, row.series_count, row.cpu_p50, row.cpu_p95) == (2, 2, 4e8, 5e8)


def test_views(spark):
    containers = waste_of(enriched(spark, API))
    pods = pod_waste(containers)
    table = {r.pod_namespace: r for r in views.cluster_table(pods).collect()}
    assert (table["prod"].owner_count, table["prod"].pod_count, table["prod"].cpu_waste_millis, table["prod"].mem_waste_mb) == (1, 2, 3390, 1480)
    assert {r.owner_name for r in views.namespace_table(pods, "dev").collect()} == {"lone", "free"}
    detail = views.one_workload(views.workload_detail(containers), "prod", "Deployment", "api").orderBy("pod_name").first()
    assert (detail.cpu_p95_millis, detail.cpu_waste_percent, detail.mem_request_mb, detail.mem_p95_mb) == (500, 75, 1000, 400)
    assert views.top_workloads(pods, 1).first().owner_name == "api"
    assert views.top_workloads_by_namespace(pods, 1).count() == 2


def test_latest_metadata_rules(spark):
    frame = enriched(spark, [API[0], API[0]]).withColumns({
        "cpu_request_millis": F.when(F.col("seq") == 0, 700).otherwise(0),
        "owner_kind": F.when(F.col("seq") == 0, "Deployment").otherwise(""),
        "owner_name": F.when(F.col("seq") == 0, "kept").otherwise(""),
    })
    row = latest_metadata(frame).first()
    assert (row.cpu_request_millis, row.owner_kind, row.owner_name) == (0, "Deployment", "kept")


def test_spec_joins(spark):
    specs = spark.createDataFrame([("ns", "p", "c", "1", "", "1Gi", "", 4, "Guaranteed", "ReplicaSet", "web-abc")], SPEC_DDL)
    frame = samples(spark, [(T0, 1)]).unionByName(samples(spark, [(T0, 2)], pod="other"))
    rows = {r.pod_name: r for r in enrich_samples(frame, parse_specs(specs)).collect()}
    assert (rows["p"].cpu_request_millis, rows["p"].mem_request_bytes, rows["p"].owner_name, rows["p"].restart_count) == (1000, 1 << 30, "web", 4)
    assert (rows["other"].cpu_request_millis, rows["other"].owner_kind, rows["other"].qos_class) == (0, "", "")
    late = report.containers(frame, specs, Tiering())
    assert {r.pod_name: r.cpu_request_millis for r in late.collect()} == {"p": 1000, "other": 0}
    two = parse_specs(specs.withColumns({"seq": F.lit(1)})).unionByName(parse_specs(specs.withColumns({"seq": F.lit(2), "cpu_request": F.lit("2")})))
    assert last_spec(two, ["seq"]).first().cpu_request_millis == 2000


def test_same_scrape_join(spark):
    specs = spark.createDataFrame([("ns", "p", "c", "1", "", "", "", 0, "", "", "")], SPEC_DDL).withColumn("scraped_at", F.lit(T0))
    frame = samples(spark, [(T0, 1), (T0 + timedelta(seconds=30), 1)]).withColumn("scraped_at", F.col("ts"))
    got = enrich_samples(frame, parse_specs(specs.withColumn("scraped_at", F.col("scraped_at").cast("timestamp_ntz"))), same_scrape=True)
    assert [r.cpu_request_millis for r in got.orderBy("ts").collect()] == [1000, 0]


@pytest.mark.parametrize("chunk", [60, 3600, 86400])
def test_as_of_join_does_not_depend_on_chunks(spark, chunk):
    minutes = [3, 65, 70, 400, 3000]
    frame = samples(spark, [(T0 + timedelta(minutes=m), m) for m in (0, 3, 4, 66, 90, 500, 2999, 4000)])
    specs = spark.createDataFrame([("ns", "p", "c", T0 + timedelta(minutes=m), m, m) for m in minutes],
                                  "pod_namespace string, pod_name string, container_name string, ts timestamp_ntz, seq bigint, cpu_request_millis bigint")
    got = {r.cpu_nano: r.cpu_request_millis for r in enrich_as_of(frame, specs, chunk).collect()}
    assert got == {0: 0, 3: 3, 4: 3, 66: 65, 90: 70, 500: 400, 2999: 400, 4000: 3000}


def test_node_report_documents(spark):
    documents = reports.node_report_documents(waste_of(enriched(spark, API)), "2026-02-28 12:00:00").collect()
    parsed = [(r.kind, json.loads(r.document)) for r in documents]
    assert {d["reportTime"] for _, d in parsed} == {"2026-02-28T12:00:00Z"}
    nodes = {d["nodeName"]: d for kind, d in parsed if kind == "node"}
    assert sorted(nodes) == ["n1", "n2"] and nodes["n2"]["totalCpuWasteMillis"] == 1700.0
    pods = {d["pod"]["podName"]: d["pod"] for kind, d in parsed if kind == "pod"}
    assert sum(d["podCount"] for d in nodes.values()) == len(pods)
    assert set(pods) == {"api-pod", "api-pod2", "lone", "free"}
    assert pods["api-pod"]["ownerRef"] == {"kind": "Deployment", "name": "api", "namespace": "prod"}
    assert pods["lone"]["ownerRef"] == {"kind": "", "name": "", "namespace": ""}
    container = pods["api-pod"]["containers"][0]
    assert set(container) == {"containerName", "cpuRequestMillis", "cpuUsage", "cpuWasteMillis", "cpuWastePercent", "memoryRequestBytes",
                              "memoryUsage", "memWasteBytes", "memWastePercent", "restartCount", "dataWindow"}
    assert container["cpuUsage"] == {"p50": 500.0, "p95": 500.0, "p99": 500.0, "max": 500.0} and container["restartCount"] == 3


def test_cluster_documents_and_empty_report(spark):
    containers = waste_of(enriched(spark, API))
    lines = [(r.kind, json.loads(r.document)) for r in reports.cluster_report_documents(containers, "2026-02-28 12:00:00").collect()]
    whole = [d for kind, d in lines if kind == "cluster"]
    assert [(d["nodeCount"], d["podCount"]) for d in whole] == [(2, 4)]
    assert {d["namespace"] for kind, d in lines if kind == "namespace"} == {"prod", "dev"}
    owners = {(d["namespace"], d["owner"]["name"]): d["podCount"] for kind, d in lines if kind == "owner"}
    listed = [d for kind, d in lines if kind == "pod" and d["namespace"] == "prod" and d["owner"]["name"] == "api"]
    assert (owners["prod", "api"], len(listed), sum(len(d["pod"]["containers"]) for d in listed)) == (2, 2, 3)
    empty = json.loads(reports.empty_node_report(spark, "n9", "2026-02-28 12:00:00").first().document)
    assert empty == {"nodeName": "n9", "reportTime": "2026-02-28T12:00:00Z", "pods": None, "totalCpuWasteMillis": 0.0, "totalMemWasteBytes": 0.0}


def test_envelopes(spark):
    at = F.lit("2026-02-28 12:00:00").cast("timestamp")
    frame = spark.range(1)
    ok = frame.select(reports.ok_envelope(F.struct(F.lit(5).alias("x")), at)).first()[0]
    bad = frame.select(reports.error_envelope(F.lit("analysis failed"), at)).first()[0]
    assert json.loads(ok) == {"status": "ok", "data": {"x": 5}, "timestamp": "2026-02-28T12:00:00Z"}
    assert json.loads(bad) == {"status": "error", "error": "analysis failed", "timestamp": "2026-02-28T12:00:00Z"}
    bodies = spark.createDataFrame([(ok,), (bad,), ("<html>Not JSON</html>",), ('{"status": "ok", "data": null}',)], "body string")
    good, failed = reports.decode_envelopes(bodies, T.StructType().add("x", T.IntegerType()))
    assert [r.data and r.data.x for r in good.collect()] == [5, None]
    assert {r.error for r in failed.collect()} == {"server error: analysis failed", "decoding response failed"}


def test_latest_report_per_node(spark):
    rows = [("a", T0, 0, 1.0, 1.0), ("a", T0 + timedelta(1), 1, 2.0, 2.0), ("b", T0, 2, 5.0, 5.0), ("b", T0, 3, 6.0, 6.0)]
    frame = spark.createDataFrame(rows, "node_name string, report_time timestamp_ntz, seq int, total_cpu_waste_millis double, total_mem_waste_bytes double")
    totals = reports.cluster_totals(reports.latest_per_node(frame)).first()
    assert list(totals) == [2, 8.0, 8.0]


def test_written_documents_are_json_lines(spark, tmp_path):
    out = str(tmp_path / "out")
    reports.write_documents(reports.node_report_documents(waste_of(enriched(spark, API)), "2026-02-28 12:00:00"), out)
    assert spark.read.json(out).count() == 6  # two nodes and four pods
