"""Views over the driver's tables, shaped like samples, specs, inventories and counters.

Each text is valid, unchanged, in Spark SQL and DuckDB. ``oracle.py`` uses the same texts as CTEs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # owner app-N has pods on several nodes; sidecars have no spec
    "fx_samples": """
SELECT concat('node-', cast(user_id % 4 AS string)) AS node_name,
       concat('ns-', cast(user_id % 6 AS string)) AS pod_namespace,
       concat('app-', cast(user_id % 30 AS string), '-7f8b9c-', cast(user_id AS string)) AS pod_name,
       CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'main' ELSE 'sidecar' END AS container_name,
       ts, event_id AS seq,
       cast(round(value * 10000000) AS bigint) AS cpu_nano,
       cast(round(value * 4000000) AS bigint) AS mem_usage,
       cast(round(value * 3000000) AS bigint) AS mem_ws
FROM events""",
    # some pods are first seen in the last days of the month
    "fx_late_pods": """
SELECT concat('node-', cast(user_id % 4 AS string)) AS node_name,
       concat('ns-', cast(user_id % 6 AS string)) AS pod_namespace,
       concat('app-', cast(user_id % 30 AS string), '-7f8b9c-', cast(user_id AS string)) AS pod_name,
       'main' AS container_name, ts, event_id AS seq,
       cast(round(value * 10000000) AS bigint) AS cpu_nano,
       cast(round(value * 4000000) AS bigint) AS mem_usage,
       cast(round(value * 3000000) AS bigint) AS mem_ws
FROM events WHERE user_id % 7 <> 3 OR ts > TIMESTAMP '2024-01-29 00:00:00'""",
    # quantities include blanks, spaces and garbage; one pod in ten has no owner
    "fx_pod_specs": """
SELECT DISTINCT concat('ns-', cast(user_id % 6 AS string)) AS pod_namespace,
       concat('app-', cast(user_id % 30 AS string), '-7f8b9c-', cast(user_id AS string)) AS pod_name,
       'main' AS container_name,
       CASE user_id % 5 WHEN 0 THEN '500m' WHEN 1 THEN '1' WHEN 2 THEN '0.25' WHEN 3 THEN ' 100m ' ELSE '' END AS cpu_request,
       CASE user_id % 4 WHEN 0 THEN '1' WHEN 1 THEN '2500m' ELSE '' END AS cpu_limit,
       CASE user_id % 5 WHEN 0 THEN '256Mi' WHEN 1 THEN '1Gi' WHEN 2 THEN '512M' WHEN 3 THEN 'abc' ELSE '' END AS mem_request,
       CASE user_id % 4 WHEN 0 THEN '2Gi' WHEN 1 THEN '1500M' ELSE '' END AS mem_limit,
       cast(user_id % 3 AS int) AS restart_count, 'Burstable' AS qos_class,
       CASE WHEN user_id % 10 = 9 THEN '' ELSE 'ReplicaSet' END AS owner_kind,
       CASE WHEN user_id % 10 = 9 THEN '' ELSE concat('app-', cast(user_id % 30 AS string), '-7f8b9c') END AS owner_name
FROM events""",
    # six busy series for every check of buckets and percentiles
    "fx_dense": """
SELECT 'node-0' AS node_name, concat('ns-', cast(user_id % 3 AS string)) AS pod_namespace,
       concat('app-', cast(user_id % 6 AS string)) AS pod_name, 'main' AS container_name, ts, event_id AS seq,
       cast(round(value * 10000000) AS bigint) AS cpu_nano,
       cast(round(value * 4000000) AS bigint) AS mem_usage,
       cast(round(value * 3000000) AS bigint) AS mem_ws
FROM events""",
    # requests grow over time and are sometimes missing; owners are sometimes missing
    "fx_annotated": """
SELECT concat('node-', cast(user_id % 4 AS string)) AS node_name,
       concat('ns-', cast(user_id % 6 AS string)) AS pod_namespace,
       concat('app-', cast(user_id % 30 AS string), '-7f8b9c-', cast(user_id AS string)) AS pod_name,
       'main' AS container_name, ts, event_id AS seq,
       CASE WHEN event_type = 'error' THEN 0 ELSE 100 + event_id % 900 END AS cpu_request_millis,
       CASE WHEN event_type = 'error' THEN 0 ELSE 1000 + event_id % 900 END AS cpu_limit_millis,
       CASE WHEN event_type = 'error' THEN 0 ELSE 1000000 * (event_id % 700) END AS mem_request_bytes,
       CASE WHEN event_type = 'error' THEN 0 ELSE 2000000 * (event_id % 700) END AS mem_limit_bytes,
       cast(event_id % 5 AS int) AS restart_count,
       CASE WHEN event_type = 'view' THEN 'BestEffort' ELSE 'Burstable' END AS qos_class,
       CASE WHEN event_type = 'click' THEN '' WHEN event_id % 2 = 0 THEN 'Deployment' ELSE 'StatefulSet' END AS owner_kind,
       CASE WHEN event_type = 'click' THEN '' ELSE concat('app-', cast(event_id % 30 AS string)) END AS owner_name
FROM events""",
    # spec changes over time: one an hour after each event of the pod
    "fx_spec_changes": """
SELECT concat('ns-', cast(user_id % 6 AS string)) AS pod_namespace,
       concat('app-', cast(user_id % 30 AS string), '-7f8b9c-', cast(user_id AS string)) AS pod_name,
       'main' AS container_name, ts + INTERVAL 1 HOUR AS ts, event_id AS seq,
       100 + event_id % 900 AS cpu_request_millis,
       1000000 * (event_id % 700) AS mem_request_bytes
FROM events""",
    # ids whose name part contains '_'; some source namespaces are empty, some sources unknown
    "fx_flux_inventory": """
SELECT concat('ns', cast(c_custkey % 40 AS string), '_', replace(lower(c_name), '#', '_'), '_apps_',
              CASE c_custkey % 4 WHEN 0 THEN 'Deployment' WHEN 1 THEN 'StatefulSet' WHEN 2 THEN 'Service' ELSE 'DaemonSet' END) AS entry_id,
       'flux-system' AS ks_namespace,
       CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE 'flux-system' END AS source_namespace,
       CASE WHEN r_name = 'ASIA' THEN 'archive' ELSE r_name END AS source_name,
       concat('./clusters/', lower(n_name)) AS path
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "fx_git_repos": """
SELECT 'flux-system' AS namespace, r_name AS name, concat('https://git.example/', lower(r_name)) AS url
FROM region""",
    "fx_argo_resources": """
SELECT concat('ns', cast(s_suppkey % 40 AS string)) AS namespace,
       CASE s_suppkey % 3 WHEN 0 THEN 'Deployment' WHEN 1 THEN 'Service' ELSE 'statefulset' END AS kind,
       replace(lower(s_name), '#', '-') AS name,
       concat('https://git.example/nation-', cast(s_nationkey AS string)) AS repo_url,
       concat('apps/', cast(s_nationkey AS string)) AS path
FROM supplier""",
    # counters that reset (event_id modulo 500); one metric in four is not on the keep-list
    "fx_counters": """
SELECT CASE user_id % 4 WHEN 0 THEN 'escalations_dispatched_total' WHEN 1 THEN 'cycle_skipped_total'
            WHEN 2 THEN 'escalation_queue_depth' ELSE 'http_requests_total' END AS metric, event_type AS label_from,
       CASE WHEN user_id % 3 = 0 THEN 'a' ELSE 'b' END AS label_to, ts, event_id AS seq,
       cast(event_id % 500 AS double) AS value
FROM events""",
    # one report per order, several per node; the newest one of a node counts
    "fx_node_reports": """
SELECT concat('node-', cast(o_custkey AS string)) AS node_name, o_orderdate AS report_time,
       o_orderkey AS seq, o_totalprice AS total_cpu_waste_millis, o_totalprice * 1024 AS total_mem_waste_bytes
FROM orders""",
}

_TABLES = ("events", "customer", "supplier", "nation", "region", "orders", "lineitem", "part")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Fixture view ``name`` over the tables in ``sf_dir``; no catalog state is left behind."""
    return sql(spark, sf_dir, VIEWS[name])


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    # every operator works in UTC; the driver's parquet times carry no zone
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for table in _TABLES:
        text = _table_reference(text, table, sf_dir)
    return spark.sql(text)


def _table_reference(text: str, table: str, sf_dir: str) -> str:
    for word in ("FROM", "JOIN"):
        text = text.replace(f"{word} {table} ", f"{word} parquet.`{sf_dir}/{table}.parquet` ")
        if text.endswith(f"{word} {table}"):
            text = text[: -len(table)] + f"parquet.`{sf_dir}/{table}.parquet`"
    return text
