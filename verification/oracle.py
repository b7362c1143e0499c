"""DuckDB SQL for every registered query, written independently of the Spark operators."""

from __future__ import annotations

from verification.fixtures import VIEWS
from verification.queries import (
    CLOCK,
    CREATED_AT,
    FX_ANNOTATED_WORKLOADS,
    FX_MANIFESTS,
    FX_PATHS,
    FX_RECOMMENDATIONS,
    FX_REQUESTS,
)

KEYS = "node_name, pod_namespace, pod_name, container_name"
WORKLOAD = "pod_namespace, owner_kind, owner_name, container_name"
METRICS = {"cpu": "cpu_nano", "usage": "mem_usage", "ws": "mem_ws"}


def with_views(body: str, *names: str, **texts: str) -> str:
    """``WITH fixture views, named texts`` in front of ``body``."""
    ctes = [f"{n} AS ({VIEWS[n].strip()})" for n in names]
    ctes += [f"{n} AS ({t.strip()})" for n, t in texts.items()]
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()


# --- tiers, buckets, summaries --------------------------------------------------------------

RAW, FINE, COARSE = "INTERVAL 1 HOUR", "INTERVAL 12 HOUR", "INTERVAL 1 DAY"
FINE_KEEP, COARSE_KEEP = "INTERVAL 7 DAY", "INTERVAL 21 DAY"


def tiered(
    source: str, as_of: str | None = None, fine_keep=FINE_KEEP, coarse_keep=COARSE_KEEP, raw=RAW
) -> str:
    if as_of is None:
        clocks = f"SELECT {KEYS}, max(ts) AS clock FROM {source} GROUP BY {KEYS}"
        base = f"SELECT s.*, c.clock FROM {source} s JOIN ({clocks}) c USING ({KEYS})"
    else:
        base = f"SELECT *, TIMESTAMP '{as_of}' AS clock FROM {source} WHERE ts <= TIMESTAMP '{as_of}'"
    return f"""
SELECT *, CASE WHEN tier = 'live' THEN clock - {raw} ELSE fine_start END AS bucket FROM (
  SELECT *, CASE WHEN ts >= clock - {raw} THEN 'live'
                 WHEN fine_start >= clock - {fine_keep} THEN 'fine'
                 WHEN time_bucket({COARSE}, fine_start) >= clock - {coarse_keep} THEN 'coarse' END AS tier
  FROM (SELECT *, time_bucket({FINE}, ts) AS fine_start FROM ({base})))
WHERE tier IS NOT NULL"""


def fine_rows(source: str, mode: str, as_of: str | None = None, **keep: str) -> str:
    columns = []
    for p, c in METRICS.items():
        rank = {k: f"quantile_disc({c}, {q})" for k, q in (("p95", 0.95), ("p99", 0.99))}
        half = f"quantile_disc({c}, 0.5) * count(*)"
        if mode == "incremental":
            half = f"CASE WHEN tier = 'live' THEN {half} ELSE sum({c}) END"
            rank = {k: f"CASE WHEN tier = 'live' THEN {v} ELSE max({c}) END" for k, v in rank.items()}
        columns.append(f"CAST({half} AS DOUBLE) AS {p}_wsum")
        columns += [f"CAST({v} AS DOUBLE) AS {p}_{k}" for k, v in rank.items()]
        columns.append(f"CAST(max({c}) AS DOUBLE) AS {p}_max")
    return f"""
SELECT {KEYS}, clock, tier, bucket, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, {', '.join(columns)}
FROM ({tiered(source, as_of, **keep)}) GROUP BY {KEYS}, clock, tier, bucket"""


SPANS = f"""
SELECT *, CASE WHEN tier = 'coarse' THEN time_bucket({COARSE}, bucket) ELSE bucket END AS b_start,
       CASE tier WHEN 'coarse' THEN time_bucket({COARSE}, bucket) + {COARSE}
                 WHEN 'fine' THEN bucket + {FINE} ELSE bucket + {RAW} END AS b_end FROM """


def merged(prefixes=("cpu", "usage", "ws"), digits: int | None = 3) -> str:
    out = ["CAST(sum(n) AS BIGINT) AS sample_count"]
    for p in prefixes:
        p50 = f"sum({p}_wsum) / sum(n)"
        out.append(f"round({p50}, {digits}) AS {p}_p50" if digits is not None else f"{p50} AS {p}_p50")
        out += [f"max({p}_{k}) AS {p}_{k}" for k in ("p95", "p99", "max")]
    return ", ".join(out)


def buckets(mode: str, tier: str | None = None) -> str:
    where = f"WHERE tier = '{tier}'" if tier else ""
    return with_views(
        f"""
SELECT {KEYS}, tier, b_start AS bucket_start, b_end AS bucket_end, {merged()}
FROM ({SPANS} fine_rows) {where} GROUP BY {KEYS}, tier, b_start, b_end""",
        "fx_dense",
        fine_rows=fine_rows("fx_dense", mode),
    )


def summary(mode: str, as_of: str | None = None) -> str:
    return with_views(
        f"SELECT {KEYS}, {merged()} FROM fine_rows GROUP BY {KEYS}",
        "fx_dense",
        fine_rows=fine_rows("fx_dense", mode, as_of),
    )


WINDOWS = f"""
SELECT {KEYS}, min(b_start) AS window_start, max(b_end) AS window_end,
       CAST(date_diff('microsecond', min(CASE WHEN tier = 'live' THEN first_ts ELSE b_start END),
                      max(CASE WHEN tier = 'live' THEN last_ts ELSE b_end END)) * 1000 AS BIGINT) AS data_window_ns
FROM ({SPANS} fine_rows) GROUP BY {KEYS}"""

# --- quantities and owners ------------------------------------------------------------------

NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def number(text: str) -> str:
    return f"CASE WHEN regexp_matches({text}, '{NUMBER}') THEN TRY_CAST({text} AS DOUBLE) END"


def cpu(text: str) -> str:
    t = f"trim({text})"
    return (
        f"CAST(coalesce(trunc(CASE WHEN {t} LIKE '%m' THEN {number(f'left({t}, length({t}) - 1)')} "
        f"ELSE ({number(t)}) * 1000 END), 0) AS BIGINT)"
    )


def memory(text: str) -> str:
    t = f"trim({text})"
    sizes = [("Ei", 2.0**60), ("Pi", 2.0**50), ("Ti", 2.0**40), ("Gi", 2.0**30), ("Mi", 2.0**20), ("Ki", 2.0**10)]
    sizes += [("E", 1e18), ("P", 1e15), ("T", 1e12), ("G", 1e9), ("M", 1e6), ("k", 1e3)]
    whens = " ".join(
        f"WHEN {t} LIKE '%{s}' THEN ({number(f'left({t}, length({t}) - {len(s)})')}) * CAST({int(m)} AS DOUBLE)"
        for s, m in sizes
    )
    return f"CAST(coalesce(trunc(CASE {whens} ELSE {number(t)} END), 0) AS BIGINT)"


DEPLOYMENT = r"regexp_extract(owner_name, '^(.+)-[^-]*$', 1)"
PROMOTED = f"owner_kind = 'ReplicaSet' AND {DEPLOYMENT} <> ''"
SPECS = f"""
SELECT pod_namespace, pod_name, container_name, {cpu('cpu_request')} AS cpu_request_millis,
       {cpu('cpu_limit')} AS cpu_limit_millis, {memory('mem_request')} AS mem_request_bytes,
       {memory('mem_limit')} AS mem_limit_bytes, restart_count, qos_class,
       CASE WHEN {PROMOTED} THEN 'Deployment' ELSE owner_kind END AS owner_kind,
       CASE WHEN {PROMOTED} THEN {DEPLOYMENT} ELSE owner_name END AS owner_name
FROM fx_pod_specs"""
SIZES = ("cpu_request_millis", "cpu_limit_millis", "mem_request_bytes", "mem_limit_bytes")
META = f"""{', '.join(f'coalesce({c}, 0) AS {c}' for c in SIZES)},
       CAST(coalesce(restart_count, 0) AS INTEGER) AS restart_count,
       coalesce(qos_class, '') AS qos_class, coalesce(owner_kind, '') AS owner_kind, coalesce(owner_name, '') AS owner_name"""

# --- waste ----------------------------------------------------------------------------------

BASE = ("fx_samples", "fx_pod_specs")


def waste_texts(as_of: str | None = None, source: str = "fx_samples", **keep: str) -> dict[str, str]:
    return {
        "fine_rows": fine_rows(source, "exact", as_of, **keep),
        "windows": WINDOWS,
        "summary": f"SELECT {KEYS}, {merged(digits=None)} FROM fine_rows GROUP BY {KEYS}",
        "specs": SPECS,
        "snapshots": f"""
SELECT {KEYS}, sample_count, data_window_ns, cpu_p50, cpu_p95, cpu_p99, cpu_max, ws_p50, ws_p95, ws_p99, ws_max, {META}
FROM summary JOIN windows USING ({KEYS}) LEFT JOIN specs USING (pod_namespace, pod_name, container_name)""",
        "container_waste": f"""
SELECT {KEYS}, owner_kind, owner_name, qos_class, cpu_request_millis, cpu_limit_millis,
       cpu_p50 / 1e6 AS cpu_p50_millis, cpu_p95 / 1e6 AS cpu_p95_millis, cpu_p99 / 1e6 AS cpu_p99_millis, cpu_max / 1e6 AS cpu_max_millis,
       cpu_waste AS cpu_waste_millis,
       CASE WHEN cpu_request_millis > 0 THEN cpu_waste / cpu_request_millis * 100 ELSE 0.0e0 END AS cpu_waste_percent,
       mem_request_bytes, mem_limit_bytes,
       ws_p50 AS mem_p50_bytes, ws_p95 AS mem_p95_bytes, ws_p99 AS mem_p99_bytes, ws_max AS mem_max_bytes,
       mem_waste AS mem_waste_bytes,
       CASE WHEN mem_request_bytes > 0 THEN mem_waste / mem_request_bytes * 100 ELSE 0.0e0 END AS mem_waste_percent,
       restart_count, sample_count, data_window_ns
FROM (SELECT *, CASE WHEN cpu_request_millis > 0 THEN greatest(cpu_request_millis - cpu_p95 / 1e6, 0.0e0) ELSE 0.0e0 END AS cpu_waste,
                CASE WHEN mem_request_bytes > 0 THEN greatest(mem_request_bytes - ws_p95, 0.0e0) ELSE 0.0e0 END AS mem_waste
      FROM snapshots)""",
        "pod_waste": """
SELECT node_name, pod_namespace, pod_name, count(*) AS container_count, max(qos_class) AS qos_class,
       max(owner_kind) AS owner_kind, max(owner_name) AS owner_name,
       sum(cpu_waste_millis) AS total_cpu_waste_millis, sum(mem_waste_bytes) AS total_mem_waste_bytes
FROM container_waste GROUP BY node_name, pod_namespace, pod_name""",
        "owned": """
SELECT * REPLACE (CASE WHEN owner_kind = '' THEN 'Pod' ELSE owner_kind END AS owner_kind,
                  CASE WHEN owner_kind = '' THEN pod_name ELSE owner_name END AS owner_name) FROM pod_waste""",
    }


def waste(body: str, **more: str) -> str:
    return with_views(body, *BASE, **waste_texts(), **more)


def at_clock(body: str, source: str) -> str:
    """Pods seen up to the clock; those without retained data have zeros and the owner of their spec."""
    texts = waste_texts(str(CLOCK), source, fine_keep="INTERVAL 1 DAY", coarse_keep="INTERVAL 2 DAY")
    live, owned = texts.pop("pod_waste"), texts.pop("owned")
    texts["live_pods"] = live
    texts["spec_owners"] = """
SELECT pod_namespace, pod_name, max(owner_kind) AS spec_kind, max(owner_name) AS spec_name FROM specs GROUP BY pod_namespace, pod_name"""
    texts["pod_waste"] = f"""
SELECT node_name, pod_namespace, pod_name, coalesce(container_count, 0) AS container_count, coalesce(qos_class, '') AS qos_class,
       CASE WHEN container_count IS NULL THEN coalesce(spec_kind, '') ELSE owner_kind END AS owner_kind,
       CASE WHEN container_count IS NULL THEN coalesce(spec_name, '') ELSE owner_name END AS owner_name,
       coalesce(total_cpu_waste_millis, 0.0e0) AS total_cpu_waste_millis, coalesce(total_mem_waste_bytes, 0.0e0) AS total_mem_waste_bytes
FROM (SELECT DISTINCT node_name, pod_namespace, pod_name FROM {source} WHERE ts <= TIMESTAMP '{CLOCK}')
LEFT JOIN live_pods USING (node_name, pod_namespace, pod_name) LEFT JOIN spec_owners USING (pod_namespace, pod_name)"""
    texts["owned"] = owned
    return with_views(body, source, "fx_pod_specs", **texts)


TOTALS = """round(sum(total_cpu_waste_millis), 6) AS total_cpu_waste_millis,
       round(sum(total_mem_waste_bytes), 6) AS total_mem_waste_bytes"""
SHOWN = """CAST(round_even(sum(total_cpu_waste_millis), 0) AS BIGINT) AS cpu_waste_millis,
       CAST(round_even(sum(total_mem_waste_bytes) / 1e6, 0) AS BIGINT) AS mem_waste_mb"""
WORKLOADS = f"""
SELECT pod_namespace, owner_kind, owner_name, count(*) AS pod_count, {TOTALS}
FROM owned GROUP BY pod_namespace, owner_kind, owner_name"""
CLUSTER_TABLE = f"""
SELECT pod_namespace, count(DISTINCT (owner_kind, owner_name)) AS owner_count, count(*) AS pod_count, {SHOWN} FROM owned GROUP BY pod_namespace"""
WASTE_DOUBLES = (
    [f"cpu_{k}_millis" for k in ("p50", "p95", "p99", "max")]
    + ["cpu_waste_millis", "cpu_waste_percent"]
    + [f"mem_{k}_bytes" for k in ("p50", "p95", "p99", "max")]
    + ["mem_waste_bytes", "mem_waste_percent"]
)


def rounding(columns, digits: int) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def level(name: str, by: tuple[str, ...]) -> str:
    names = ("node_name", "pod_namespace", "owner_kind", "owner_name")
    columns = ", ".join(c if c in by else f"CAST(NULL AS VARCHAR) AS {c}" for c in names)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    return f"SELECT '{name}' AS level, {columns}, count(*) AS pod_count, {TOTALS} FROM owned {group}"


# --- recommendations ------------------------------------------------------------------------

STEP = "INTERVAL 12 HOUR"
IDLE_CPU = "500.0e0"
PROFILE_TEXTS = {
    "fine_rows": fine_rows("fx_samples", "exact"),
    "specs": SPECS,
    "pod_owners": "SELECT pod_namespace, pod_name, max(owner_kind) AS owner_kind, max(owner_name) AS owner_name FROM specs GROUP BY pod_namespace, pod_name",
    "placed": f"""
SELECT r.*, time_bucket({STEP}, bucket) AS step,
       CASE WHEN tier = 'live' THEN first_ts ELSE b_start END AS from_ts, CASE WHEN tier = 'live' THEN last_ts ELSE b_end END AS to_ts,
       CASE WHEN coalesce(o.owner_kind, '') = '' THEN 'Pod' ELSE o.owner_kind END AS owner_kind,
       CASE WHEN coalesce(o.owner_kind, '') = '' THEN r.pod_name ELSE o.owner_name END AS owner_name,
       {', '.join(f'coalesce(s.{c}, 0) AS {c}' for c in SIZES)}
FROM ({SPANS} fine_rows) r
LEFT JOIN pod_owners o ON o.pod_namespace = r.pod_namespace AND o.pod_name = r.pod_name
LEFT JOIN specs s ON s.pod_namespace = r.pod_namespace AND s.pod_name = r.pod_name AND s.container_name = r.container_name""",
    "steps": f"""
SELECT *, cpu_max / 1e6 < greatest({IDLE_CPU}, cpu_request_millis * 0.02e0) AS is_idle FROM (
  SELECT {WORKLOAD}, step, sum(n) AS n, sum(cpu_wsum) AS cpu_wsum, sum(ws_wsum) AS ws_wsum,
         max(cpu_p95) AS cpu_p95, max(cpu_p99) AS cpu_p99, max(cpu_max) AS cpu_max,
         max(ws_p95) AS ws_p95, max(ws_p99) AS ws_p99, max(ws_max) AS ws_max,
         min(from_ts) AS from_ts, max(to_ts) AS to_ts, {', '.join(f'max({c}) AS {c}' for c in SIZES)},
         sum(cpu_wsum) / sum(n) / 1e6 AS cpu_mean, sum(ws_wsum) / sum(n) AS mem_mean
  FROM placed GROUP BY {WORKLOAD}, step)""",
    "runs": f"""
SELECT {WORKLOAD}, CAST(count(*) * 43200 AS BIGINT) AS run_seconds, min(step) AS run_start FROM (
  SELECT *, step - {STEP} * row_number() OVER (PARTITION BY {WORKLOAD} ORDER BY step) AS island FROM steps WHERE is_idle)
GROUP BY {WORKLOAD}, island""",
    "growth": f"""
SELECT {WORKLOAD}, count(rise) AS growth_steps, coalesce(avg(rise), 0) AS growth_share,
       coalesce(regr_slope(mem_mean, hours), 0) AS growth_slope
FROM (SELECT *, CASE WHEN prev IS NOT NULL THEN CAST(mem_mean >= prev AS INTEGER) END AS rise,
             date_diff('microsecond', first_step, step) / 3.6e9 AS hours
      FROM (SELECT *, lag(mem_mean) OVER (PARTITION BY {WORKLOAD} ORDER BY step) AS prev,
                   min(step) OVER (PARTITION BY {WORKLOAD}) AS first_step FROM steps))
GROUP BY {WORKLOAD}""",
    "features": f"""
SELECT u.*, coalesce(r.idle_seconds, 0) AS idle_seconds, growth_steps, growth_share, growth_slope,
       coalesce(step_sd / nullif(step_mean, 0), 0) AS variation, coalesce(cpu_max / nullif(cpu_p50, 0), 0) AS peak_ratio
FROM (SELECT {WORKLOAD}, CAST(sum(n) AS BIGINT) AS n, sum(cpu_wsum) / sum(n) AS cpu_p50, sum(ws_wsum) / sum(n) AS ws_p50,
             max(cpu_p95) AS cpu_p95, max(cpu_p99) AS cpu_p99, max(cpu_max) AS cpu_max,
             max(ws_p95) AS ws_p95, max(ws_p99) AS ws_p99, max(ws_max) AS ws_max,
             {', '.join(f'max({c}) AS {c}' for c in SIZES)},
             CAST(date_diff('microsecond', min(from_ts), max(to_ts)) * 1000 AS BIGINT) AS data_window_ns, count(*) AS steps,
             avg(cpu_mean) AS step_mean, stddev_pop(cpu_mean) AS step_sd, avg(CAST(is_idle AS INTEGER)) AS idle_share
      FROM steps GROUP BY {WORKLOAD}) u
JOIN growth USING ({WORKLOAD})
LEFT JOIN (SELECT runs.* RENAME (run_seconds AS idle_seconds) FROM runs JOIN (SELECT {WORKLOAD}, max(step) AS last FROM steps GROUP BY {WORKLOAD})
           USING ({WORKLOAD}) WHERE run_start + to_seconds(run_seconds) = last + {STEP}) r USING ({WORKLOAD})""",
    "patterns": """
SELECT *, CASE WHEN idle_seconds >= 172800 THEN 'idle'
               WHEN growth_steps >= 20 AND growth_share >= 0.5e0 AND growth_slope > 0 THEN 'anomalous'
               WHEN peak_ratio >= 4.0e0 AND idle_share >= 0.3e0 THEN 'batch'
               WHEN peak_ratio >= 6.5e0 OR variation >= 0.75e0 THEN 'burstable' ELSE 'steady' END AS pattern
FROM features""",
}
RECOMMENDATIONS_TEXTS = PROFILE_TEXTS | {
    "rated": """
SELECT *, round(least(1.0e0, data_window_ns / CAST(604800 * 1e9 AS DOUBLE)) * 0.6e0
               + least(1.0e0, n / 2016.0e0) * (1 - 0.6e0), 4) AS confidence FROM patterns""",
    "per_resource": f"""
SELECT {WORKLOAD}, pattern, confidence, data_window_ns, 'cpu' AS resource, cpu_request_millis AS cur, cpu_limit_millis AS cur_limit,
       cpu_p50 / 1e6 AS p50, cpu_p95 / 1e6 AS p95, cpu_max / 1e6 AS peak, CAST(50 AS BIGINT) AS floor_at FROM rated
UNION ALL
SELECT {WORKLOAD}, pattern, confidence, data_window_ns, 'memory', mem_request_bytes, mem_limit_bytes,
       ws_p50, ws_p95, ws_max, greatest(67108864, CAST(ceil(ws_p99 * 1.1e0) AS BIGINT)) FROM rated""",
    "proposed": """
SELECT *, CASE pattern WHEN 'steady' THEN p95 * 1.15e0 WHEN 'burstable' THEN p50 * 1.25e0 WHEN 'batch' THEN p95 * 1.1e0 END AS want,
       CASE pattern WHEN 'steady' THEN peak * 1.2e0 WHEN 'burstable' THEN peak * 1.25e0 WHEN 'batch' THEN peak * 1.5e0 END AS want_limit,
       cur * (1 - CASE WHEN confidence < 0.5e0 THEN 0.2e0 WHEN confidence < 0.8e0 THEN 0.35e0 ELSE 0.5e0 END) AS lowest
FROM per_resource""",
    "sized": """
SELECT *, greatest(CASE WHEN want IS NULL THEN cur ELSE greatest(CAST(ceil(want) AS BIGINT), CAST(ceil(lowest) AS BIGINT)) END, floor_at) AS rec
FROM proposed""",
    "recs": f"""
SELECT {WORKLOAD}, resource, cur AS current_request, cur_limit AS current_limit, rec AS recommended_request,
       CASE WHEN want_limit IS NOT NULL THEN greatest(CAST(ceil(want_limit) AS BIGINT), rec)
            WHEN cur_limit > 0 THEN greatest(cur_limit, rec) ELSE 0 END AS recommended_limit,
       pattern, confidence,
       pattern || ' ' || resource || ' usage: P50 ' || CAST(CAST(round_even(p50, 0) AS BIGINT) AS VARCHAR) || u || ', P95 '
         || CAST(CAST(round_even(p95, 0) AS BIGINT) AS VARCHAR) || u || ', max ' || CAST(CAST(round_even(peak, 0) AS BIGINT) AS VARCHAR) || u
         || CASE WHEN want_limit IS NULL THEN '; flagged for investigation' ELSE '' END AS reasoning,
       cur - rec AS est_savings,
       CASE WHEN confidence < 0.5e0 OR cut > 0.6e0 THEN 'HIGH' WHEN confidence >= 0.8e0 AND cut <= 0.3e0 THEN 'LOW' ELSE 'MEDIUM' END AS risk,
       data_window_ns
FROM (SELECT *, CASE WHEN cur > 0 THEN (cur - rec) / CAST(cur AS DOUBLE) ELSE 0 END AS cut,
             CASE WHEN resource = 'cpu' THEN 'm' ELSE ' bytes' END AS u FROM sized)""",
}


def profile(body: str) -> str:
    return with_views(body, *BASE, **PROFILE_TEXTS)


def recs(body: str, **more: str) -> str:
    return with_views(body, *BASE, **RECOMMENDATIONS_TEXTS, **more)


def fmt_cpu(c: str) -> str:
    return f"CASE WHEN {c} % 1000 = 0 THEN CAST({c} // 1000 AS VARCHAR) ELSE CAST({c} AS VARCHAR) || 'm' END"


def fmt_memory(c: str) -> str:
    return (
        f"CASE WHEN {c} >= 1073741824 AND {c} % 1073741824 = 0 THEN CAST({c} // 1073741824 AS VARCHAR) || 'Gi' "
        f"WHEN {c} >= 1048576 THEN CAST({c} // 1048576 AS VARCHAR) || 'Mi' ELSE CAST({c} AS VARCHAR) END"
    )


def shown(c: str) -> str:
    return f"CASE WHEN resource = 'cpu' THEN {fmt_cpu(c)} ELSE {fmt_memory(c)} END"


TITLE = "'chore: right-size ' || lower(owner_kind) || '/' || owner_name || ' resources'"
LABEL = "CASE WHEN resource = 'cpu' THEN 'CPU' ELSE 'Memory' END"
BODY = f"""'## Right-sizing: ' || owner_kind || '/' || owner_name || chr(10) || chr(10)
       || '**Namespace:** ' || pod_namespace || chr(10) || '**Pattern:** ' || pattern || chr(10)
       || '**Confidence:** ' || CAST(CAST(round_even(confidence * 100, 0) AS BIGINT) AS VARCHAR) || '%' || chr(10)
       || '**Risk:** ' || risk || chr(10) || chr(10) || '### Changes' || chr(10) || chr(10)
       || '| Resource | Current | Recommended |' || chr(10) || '|----------|---------|-------------|' || chr(10)
       || '| ' || {LABEL} || ' request | ' || {shown('current_request')} || ' | ' || {shown('recommended_request')} || ' |' || chr(10)
       || CASE WHEN recommended_limit > 0 THEN '| ' || {LABEL} || ' limit | ' || {shown('current_limit')} || ' | '
               || {shown('recommended_limit')} || ' |' || chr(10) ELSE '' END
       || chr(10) || '**Reasoning:** ' || reasoning || chr(10) || chr(10) || '---' || chr(10) || 'Generated by trimline' || chr(10)"""

ONE_PER_TARGET = """
SELECT * EXCLUDE (place) FROM (
  SELECT *, row_number() OVER (PARTITION BY pod_namespace, lower(owner_kind), owner_name
                               ORDER BY resource <> 'cpu', container_name, resource) AS place FROM recs) WHERE place = 1"""

SOURCES = """
SELECT namespace, kind, name, coalesce(annotations::JSON ->> '$."sizing.example/repo"', '') AS repo,
       coalesce(annotations::JSON ->> '$."sizing.example/path"', '') AS path,
       coalesce(annotations::JSON ->> '$."sizing.example/field"', '') AS field
FROM fx_workloads"""
MISSING = "CASE WHEN repo = '' OR path = '' THEN 'missing required annotations sizing.example/repo and sizing.example/path' END"

# --- mappings -------------------------------------------------------------------------------

WORKLOAD_KINDS = "('deployment', 'statefulset', 'daemonset')"
ID = "'^([^_]*)_(.*)_([^_]*)_([^_]*)$'"
FLUX = f"""
SELECT namespace, kind, name, coalesce(url, '') AS repo_url, path, 'flux' AS source_tool FROM (
  SELECT regexp_extract(entry_id, {ID}, 1) AS namespace, regexp_extract(entry_id, {ID}, 2) AS name,
         regexp_extract(entry_id, {ID}, 4) AS kind, path, source_name,
         CASE WHEN source_namespace = '' THEN ks_namespace ELSE source_namespace END AS source_ns
  FROM fx_flux_inventory WHERE regexp_matches(entry_id, {ID})) e
LEFT JOIN (SELECT namespace AS r_ns, name AS repo_name, url FROM fx_git_repos) r ON r_ns = source_ns AND repo_name = source_name
WHERE lower(kind) IN {WORKLOAD_KINDS}"""
ARGO = f"""
SELECT namespace, kind, name, repo_url, path, 'argocd' AS source_tool FROM fx_argo_resources WHERE lower(kind) IN {WORKLOAD_KINDS}"""
ALL_MAPPINGS = f"SELECT * FROM ({ARGO}) UNION ALL SELECT * FROM ({FLUX})"
MAPPING_VIEWS = ("fx_flux_inventory", "fx_git_repos", "fx_argo_resources")

# --- counters -------------------------------------------------------------------------------

INCREASES = """
SELECT metric, label_from, label_to, ts,
       CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS delta
FROM (SELECT *, lag(value) OVER (PARTITION BY metric, label_from, label_to ORDER BY ts, seq) AS prev FROM fx_counters)"""

# --- manifests: the text is rebuilt with the expected values instead of being edited ------------

EDITED = r"""
SELECT *, matches AND (req <> old OR (recommended_limit > 0 AND lim <> old)) AS editable FROM (
SELECT p_partkey, path, resource, cpu_value, mem_value, recommended_limit, CASE WHEN resource = 'cpu' THEN cpu_value ELSE mem_value END AS old,
       CASE WHEN resource = 'cpu' THEN REQ_CPU ELSE REQ_MEM END AS req,
       CASE WHEN resource = 'cpu' THEN LIM_CPU ELSE LIM_MEM END AS lim,
       resource = 'cpu' AND cpu_value = '0.5' AS odd,
       CASE WHEN resource = 'cpu' THEN cpu_value <> '0.5' ELSE mem_value <> '134217728' END AS matches
FROM fx_manifests)"""
EDITED = (
    EDITED.replace("REQ_CPU", fmt_cpu("recommended_request"))
    .replace("REQ_MEM", fmt_memory("recommended_request"))
    .replace("LIM_CPU", fmt_cpu("recommended_limit"))
    .replace("LIM_MEM", fmt_memory("recommended_limit"))
)


def manifest(cpu1: str, mem1: str, cpu2: str, mem2: str) -> str:
    return (
        "'kind: Deployment' || chr(10) || 'spec:' || chr(10) || '  resources:' || chr(10) || '    requests:' || chr(10) "
        f"|| '      cpu: ' || {cpu1} || chr(10) || '      memory: ' || {mem1} || chr(10) || '    limits:' || chr(10) "
        f"|| '      cpu: ' || {cpu2} || ' # max' || chr(10) || '      memory: ' || {mem2} || chr(10) || 'end: 1'"
    )


def _set(resource: str, value: str, old: str, extra: str = "TRUE") -> str:
    return f"CASE WHEN resource = '{resource}' AND editable AND {extra} THEN {value} ELSE {old} END"


ORACLES: dict[str, str] = {
    "series_keys": with_views(
        f"SELECT DISTINCT node_name, pod_namespace || '/' || pod_name || '/' || container_name AS series_key, pod_namespace, pod_name, container_name FROM fx_samples",
        "fx_samples",
    ),
    "metric_aggregate": """
SELECT l_suppkey, count(*) AS n, max(l_extendedprice) AS price_max, quantile_disc(l_extendedprice, 0.5) AS price_p50,
       quantile_disc(l_extendedprice, 0.95) AS price_p95, quantile_disc(l_extendedprice, 0.99) AS price_p99
FROM lineitem GROUP BY l_suppkey""",
    "metric_aggregate_split": """
SELECT l_returnflag, count(*) AS n, max(l_extendedprice) AS price_max, quantile_disc(l_extendedprice, 0.5) AS price_p50,
       quantile_disc(l_extendedprice, 0.95) AS price_p95, quantile_disc(l_extendedprice, 0.99) AS price_p99,
       max(l_quantity) AS quantity_max, quantile_disc(l_quantity, 0.5) AS quantity_p50,
       quantile_disc(l_quantity, 0.95) AS quantity_p95, quantile_disc(l_quantity, 0.99) AS quantity_p99
FROM lineitem GROUP BY l_returnflag""",
    "tier_counts": with_views(
        f"SELECT {KEYS}, tier, count(*) AS n FROM ({tiered('fx_dense')}) GROUP BY {KEYS}, tier", "fx_dense"
    ),
    "buckets_fine_exact": buckets("exact", "fine"),
    "buckets_fine_incremental": buckets("incremental", "fine"),
    "buckets_coarse": buckets("exact", "coarse"),
    "buckets_all": buckets("incremental"),
    "series_summary_exact": summary("exact"),
    "series_summary_incremental": summary("incremental"),
    "series_summary_fixed_clock": summary("exact", str(CLOCK)),
    "series_summary_fixed_clock_incremental": summary("incremental", str(CLOCK)),
    "series_summary_hot": summary("exact"),
    "data_window": with_views(WINDOWS, "fx_samples", fine_rows=fine_rows("fx_samples", "incremental")),
    "series_meta": with_views(
        f"""
SELECT {KEYS}, arg_max(cpu_request_millis, ord) AS cpu_request_millis, arg_max(cpu_limit_millis, ord) AS cpu_limit_millis,
       arg_max(mem_request_bytes, ord) AS mem_request_bytes, arg_max(mem_limit_bytes, ord) AS mem_limit_bytes,
       arg_max(restart_count, ord) AS restart_count, arg_max(qos_class, ord) AS qos_class,
       coalesce(arg_max(owner_kind, ord) FILTER (WHERE owner_kind <> ''), '') AS owner_kind,
       coalesce(arg_max(owner_name, ord) FILTER (WHERE owner_kind <> ''), '') AS owner_name
FROM (SELECT *, row_number() OVER (ORDER BY ts, seq) AS ord FROM fx_annotated) GROUP BY {KEYS}""",
        "fx_annotated",
    ),
    "samples_enriched": with_views(
        f"SELECT {KEYS}, ts, seq, cpu_nano, mem_usage, mem_ws, {META} FROM fx_samples LEFT JOIN specs USING (pod_namespace, pod_name, container_name)",
        *BASE,
        specs=SPECS,
    ),
    "samples_enriched_same_scrape": with_views(
        f"""
SELECT {KEYS}, ts, seq, cpu_nano,
       coalesce(max(CASE WHEN seq % 2 = 0 THEN seq % 900 END) OVER (PARTITION BY pod_namespace, pod_name, container_name, ts), 0) AS cpu_request_millis
FROM fx_samples""",
        "fx_samples",
    ),
    "samples_enriched_as_of": with_views(
        f"""
SELECT {KEYS}, ts, seq, cpu_nano,
       coalesce(last_value(cpu_request_millis IGNORE NULLS) OVER w, 0) AS cpu_request_millis,
       coalesce(last_value(mem_request_bytes IGNORE NULLS) OVER w, 0) AS mem_request_bytes
FROM (SELECT {KEYS}, ts, 1 AS side, seq, cpu_nano, NULL AS cpu_request_millis, NULL AS mem_request_bytes FROM fx_samples
      UNION ALL SELECT NULL, pod_namespace, pod_name, container_name, ts, 0, seq, NULL, cpu_request_millis, mem_request_bytes FROM fx_spec_changes)
WINDOW w AS (PARTITION BY pod_namespace, pod_name, container_name ORDER BY ts, side, seq ROWS UNBOUNDED PRECEDING)
QUALIFY side = 1""",
        "fx_samples",
        "fx_spec_changes",
    ),
    "formatted_quantities": f"""
SELECT o_orderkey, {fmt_cpu('(o_custkey * 50)')} AS cpu, {fmt_memory('size')} AS memory, {fmt_memory('(o_custkey * 268435456)')} AS memory_blocks
FROM (SELECT o_orderkey, o_custkey, cast(round(o_totalprice * 1048576 / 50) AS bigint) AS size FROM orders)""",
    "owner_names": with_views("SELECT pod_namespace, pod_name, owner_kind AS kind, owner_name AS name FROM specs", "fx_pod_specs", specs=SPECS),
    "usage_documents": with_views(
        f"SELECT {KEYS}, ts, seq, CASE WHEN seq % 3 = 0 THEN 0 ELSE cpu_nano END AS cpu_nano, mem_usage, mem_ws FROM fx_samples",
        "fx_samples",
    ),
    "pod_documents": with_views("SELECT * FROM specs", "fx_pod_specs", specs=SPECS),
    "container_waste": waste(
        f"SELECT * REPLACE ({rounding(WASTE_DOUBLES, 3)}) FROM container_waste"
    ),
    "pod_waste": waste(
        f"SELECT * REPLACE ({rounding(['total_cpu_waste_millis', 'total_mem_waste_bytes'], 6)}) FROM pod_waste"
    ),
    "pod_waste_fixed_clock": at_clock(
        f"SELECT * REPLACE ({rounding(['total_cpu_waste_millis', 'total_mem_waste_bytes'], 6)}) FROM pod_waste", "fx_samples"
    ),
    "workloads_fixed_clock": at_clock(WORKLOADS, "fx_late_pods"),
    "cluster_table_fixed_clock": at_clock(CLUSTER_TABLE, "fx_late_pods"),
    "node_waste": waste(f"SELECT node_name, count(*) AS pod_count, {TOTALS} FROM pod_waste GROUP BY node_name"),
    "workloads": waste(WORKLOADS),
    "workload_usage": waste(
        f"""
SELECT {WORKLOAD}, CAST(sum(sample_count) AS BIGINT) AS n, max(cpu_p95) AS cpu_p95, max(cpu_p99) AS cpu_p99, max(cpu_max) AS cpu_max,
       max(ws_p95) AS ws_p95, max(ws_p99) AS ws_p99, max(ws_max) AS ws_max, count(*) AS series_count,
       {', '.join(f'max({c}) AS {c}' for c in SIZES)}, max(data_window_ns) AS data_window_ns,
       round(sum(cpu_p50 * sample_count) / sum(sample_count), 3) AS cpu_p50, round(sum(ws_p50 * sample_count) / sum(sample_count), 3) AS ws_p50
FROM (SELECT * REPLACE (CASE WHEN owner_kind = '' THEN 'Pod' ELSE owner_kind END AS owner_kind,
                        CASE WHEN owner_kind = '' THEN pod_name ELSE owner_name END AS owner_name) FROM snapshots)
GROUP BY {WORKLOAD}"""
    ),
    "cluster_table": waste(CLUSTER_TABLE),
    "cluster_totals": waste(
        f"SELECT count(DISTINCT node_name) AS node_count, count(*) AS pod_count, {TOTALS} FROM pod_waste"
    ),
    "waste_grouping_sets": waste(
        " UNION ALL ".join(
            [
                level("node", ("node_name",)),
                level("namespace", ("pod_namespace",)),
                level("workload", ("pod_namespace", "owner_kind", "owner_name")),
                level("cluster", ()),
            ]
        )
    ),
    "namespace_table": waste(
        f"SELECT owner_name, owner_kind, count(*) AS pod_count, {SHOWN} FROM owned WHERE pod_namespace = 'ns-1' GROUP BY owner_name, owner_kind"
    ),
    "workloads_table": waste(
        f"SELECT pod_namespace, owner_kind, owner_name, count(*) AS pod_count, {SHOWN} FROM owned GROUP BY pod_namespace, owner_kind, owner_name"
    ),
    "workload_detail": waste(
        """
SELECT pod_namespace, CASE WHEN owner_kind = '' THEN 'Pod' ELSE owner_kind END AS owner_kind,
       CASE WHEN owner_kind = '' THEN pod_name ELSE owner_name END AS owner_name, node_name, pod_name, container_name, cpu_request_millis,
       CAST(round_even(cpu_p95_millis, 0) AS BIGINT) AS cpu_p95_millis, CAST(round_even(cpu_waste_percent, 0) AS BIGINT) AS cpu_waste_percent,
       mem_request_bytes // 1000000 AS mem_request_mb, CAST(round_even(mem_p95_bytes / 1e6, 0) AS BIGINT) AS mem_p95_mb,
       CAST(round_even(mem_waste_percent, 0) AS BIGINT) AS mem_waste_percent
FROM container_waste"""
    ),
    "top_workloads": waste(
        f"SELECT * FROM ({WORKLOADS}) ORDER BY total_cpu_waste_millis DESC, pod_namespace, owner_kind, owner_name LIMIT 5"
    ),
    "top_workloads_by_namespace": waste(
        f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY pod_namespace ORDER BY total_cpu_waste_millis DESC, owner_kind, owner_name) AS INTEGER) AS place
               FROM ({WORKLOADS})) WHERE place <= 2"""
    ),
    "waste_by_namespace": waste(f"SELECT pod_namespace, {TOTALS} FROM pod_waste GROUP BY pod_namespace"),
    "latest_node_reports": with_views(
        """
SELECT * FROM fx_node_reports
QUALIFY row_number() OVER (PARTITION BY node_name ORDER BY report_time DESC, seq DESC) = 1""",
        "fx_node_reports",
    ),
    "node_report_totals": with_views(
        """
SELECT count(*) AS node_count, round(sum(total_cpu_waste_millis), 0) AS total_cpu_waste_millis, round(sum(total_mem_waste_bytes), 0) AS total_mem_waste_bytes
FROM (SELECT * FROM fx_node_reports QUALIFY row_number() OVER (PARTITION BY node_name ORDER BY report_time DESC, seq DESC) = 1)""",
        "fx_node_reports",
    ),
    "node_report_documents": waste(
        f"""
SELECT node_name, strftime(TIMESTAMP '{CREATED_AT}', '%Y-%m-%dT%H:%M:%SZ') AS report_time, pod_namespace, pod_name, owner_name,
       round(total_cpu_waste_millis, 4) AS pod_cpu_waste, count(*) OVER (PARTITION BY node_name) AS node_pods, round(sum(total_mem_waste_bytes) OVER (PARTITION BY node_name), 4) AS node_mem_waste
FROM pod_waste"""
    ),
    "cluster_report_documents": waste(
        """
SELECT o.pod_namespace, o.owner_kind, o.owner_name, count(DISTINCT (o.node_name, o.pod_name)) AS owner_pods,
       any_value(t.node_count) AS node_count, any_value(t.pod_count) AS pod_count, count(*) AS containers,
       round(sum(c.cpu_waste_millis), 4) AS cpu_waste_millis
FROM container_waste c JOIN owned o ON c.node_name = o.node_name AND c.pod_namespace = o.pod_namespace AND c.pod_name = o.pod_name,
     (SELECT count(DISTINCT node_name) AS node_count, count(*) AS pod_count FROM pod_waste) t
GROUP BY o.pod_namespace, o.owner_kind, o.owner_name"""
    ),
    "envelopes": """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS total,
       CASE WHEN o_orderstatus <> 'F' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS timestamp,
       CASE WHEN o_orderstatus = 'F' THEN 'server error: order ' || CAST(o_orderkey AS VARCHAR) END AS error
FROM orders""",
    "patterns": profile(
        f"""
SELECT {WORKLOAD}, pattern, n, steps, idle_seconds, round(idle_share, 4) AS idle_share, round(variation, 4) AS variation,
       round(peak_ratio, 4) AS peak_ratio, round(cpu_p50, 4) AS cpu_p50, cpu_p95, ws_p99, data_window_ns FROM patterns"""
    ),
    "idle_runs": profile(f"SELECT {WORKLOAD}, run_seconds, run_start FROM runs"),
    "memory_growth": profile(
        f"SELECT {WORKLOAD}, growth_steps, round(growth_share, 4) AS growth_share, round(growth_slope, 4) AS growth_slope FROM growth"
    ),
    "recommendations": recs("SELECT * FROM recs"),
    "recommendations_filtered": recs("SELECT * FROM recs WHERE risk = 'MEDIUM' AND pod_namespace = 'ns-2'"),
    "recommendations_ranked": recs(
        """
SELECT pod_namespace || '/' || owner_name AS target, container_name, resource, current_request, recommended_request, est_savings, risk,
       CAST(round_even(confidence * 100, 0) AS BIGINT) AS confidence_percent FROM recs
ORDER BY est_savings DESC, pod_namespace, owner_kind, owner_name, container_name, resource"""
    ),
    "recommendations_by_confidence": recs(
        """
SELECT pod_namespace || '/' || owner_name AS target, container_name, resource, current_request, recommended_request, est_savings, risk,
       CAST(round_even(confidence * 100, 0) AS BIGINT) AS confidence_percent FROM recs
ORDER BY confidence DESC, pod_namespace, owner_kind, owner_name, container_name, resource"""
    ),
    "savings_by_resource": recs(
        "SELECT resource, count(*) AS recommendations, CAST(sum(est_savings) AS BIGINT) AS est_savings FROM recs GROUP BY resource"
    ),
    "one_per_target": recs(ONE_PER_TARGET),
    "change_body": recs(
        f"SELECT pod_namespace, owner_kind, owner_name, container_name, resource, {TITLE} AS title, {BODY} AS body FROM recs"
    ),
    "digest": with_views(
        """
SELECT digest_start, pod_namespace, owner_kind, owner_name, container_name, resource, severity, pattern, est_savings, ts, seq
FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) AS digest_start,
             CASE WHEN pattern = 'idle' THEN 'warning' WHEN est_savings > 0 THEN 'optimisation' ELSE 'info' END AS severity FROM incoming)
WHERE severity <> 'info'
QUALIFY row_number() OVER (PARTITION BY digest_start, pod_namespace, owner_kind, owner_name, container_name, resource ORDER BY ts, seq) = 1""",
        incoming=FX_RECOMMENDATIONS,
    ),
    "flux_mappings": with_views(FLUX, "fx_flux_inventory", "fx_git_repos"),
    "mappings": with_views(ALL_MAPPINGS, *MAPPING_VIEWS),
    "annotate_commands": with_views(
        """
SELECT 'trimline annotate ' || lower(kind) || '/' || name || ' -n ' || namespace || ' --repo ' || repo_url || ' --path ' || path AS display,
       CAST(8 AS BIGINT) AS n_args, lower(kind) || '/' || name AS target FROM mappings""",
        *MAPPING_VIEWS,
        mappings=ALL_MAPPINGS,
    ),
    "annotation_arguments": with_views(
        """
SELECT p_partkey, error,
       CASE WHEN error IS NULL THEN 'annotate ' || target || CASE WHEN namespace <> '' THEN ' -n ' || namespace ELSE '' END
            || ' sizing.example/repo=' || repo || ' sizing.example/path=' || path
            || CASE WHEN field <> '' THEN ' sizing.example/field=' || field ELSE '' END || ' --overwrite' END AS arguments
FROM (SELECT *, CASE WHEN strpos(target, '/') <= 1 OR strpos(target, '/') = length(target) THEN 'target must be in kind/name format: ' || target
                     WHEN repo = '' THEN 'repo is required' WHEN path = '' THEN 'path is required'
                     WHEN repo LIKE '-%' OR path LIKE '-%' OR field LIKE '-%' THEN 'values must not start with ''-''' END AS error FROM requests)""",
        requests=FX_REQUESTS,
    ),
    "path_escapes": with_views(
        "SELECT o_orderkey, path IN ('../x', 'a/../../b', '.') AS escapes FROM paths", paths=FX_PATHS
    ),
    "source_annotations": with_views(
        f"SELECT *, {MISSING} AS annotation_error FROM sources",
        fx_workloads=FX_ANNOTATED_WORKLOADS,
        sources=SOURCES,
    ),
    "change_requests": recs(
        f"""
SELECT pod_namespace, owner_kind, owner_name, container_name, resource, {TITLE} AS title,
       'right-size/' || pod_namespace || '-' || owner_name || '-20240201-102030' AS branch, repo, path, field, {MISSING} AS error, {BODY} AS body
FROM ({ONE_PER_TARGET}) r JOIN sources s ON s.namespace = r.pod_namespace AND lower(s.kind) = lower(r.owner_kind) AND s.name = r.owner_name""",
        fx_workloads=FX_ANNOTATED_WORKLOADS,
        sources=SOURCES,
    ),
    "manifest_edits": with_views(
        f"""
SELECT p_partkey, resource, {manifest(_set('cpu', 'req', 'cpu_value'), _set('memory', 'req', 'mem_value'),
       _set('cpu', 'lim', 'cpu_value', 'recommended_limit > 0'), _set('memory', 'lim', 'mem_value', 'recommended_limit > 0'))} AS new_content,
       editable AS changed, CASE WHEN odd THEN 'resource value of an unsupported form' WHEN NOT editable THEN 'manifest holds no resource value that differs' END AS error
FROM edited""",
        fx_manifests=FX_MANIFESTS,
        edited=EDITED,
    ),
    "manifest_edits_joined": recs(
        f"""
SELECT repo, path, resource, {manifest("CASE WHEN resource = 'cpu' THEN req ELSE '1' END", "CASE WHEN resource = 'memory' THEN req ELSE '1Gi' END",
       "CASE WHEN resource = 'cpu' AND recommended_limit > 0 THEN lim ELSE '2' END", "CASE WHEN resource = 'memory' AND recommended_limit > 0 THEN lim ELSE '2Gi' END")} AS new_content,
       TRUE AS changed, CAST(NULL AS VARCHAR) AS error
FROM (SELECT *, {shown('recommended_request')} AS req, {shown('recommended_limit')} AS lim
      FROM ({ONE_PER_TARGET}) r JOIN sources s ON s.namespace = r.pod_namespace AND lower(s.kind) = lower(r.owner_kind) AND s.name = r.owner_name
      WHERE repo <> '' AND path <> '')""",
        fx_workloads=FX_ANNOTATED_WORKLOADS,
        sources=SOURCES,
    ),
    "counter_rate": with_views(
        f"""
SELECT metric, label_from, label_to, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, round(sum(delta) / 3600.0e0, 6) AS rate
FROM ({INCREASES}) GROUP BY metric, label_from, label_to, time_bucket(INTERVAL 1 HOUR, ts)""",
        "fx_counters",
    ),
    "counter_increase": with_views(
        f"""
SELECT metric, label_from, label_to, time_bucket(INTERVAL 1 DAY, ts) AS window_start, round(sum(delta), 6) AS increase
FROM ({INCREASES}) GROUP BY metric, label_from, label_to, time_bucket(INTERVAL 1 DAY, ts)""",
        "fx_counters",
    ),
    "increase_by_labels": with_views(
        f"""
SELECT metric, label_to, round(sum(delta), 6) AS increase FROM ({INCREASES})
WHERE metric IN ('escalation_queue_depth', 'escalations_dispatched_total', 'escalation_degradations_total', 'cycle_skipped_total')
GROUP BY metric, label_to""",
        "fx_counters",
    ),
    "latest_gauge": with_views(
        """
SELECT metric, label_from, label_to, value FROM fx_counters
QUALIFY row_number() OVER (PARTITION BY metric, label_from, label_to ORDER BY ts DESC, seq DESC) = 1""",
        "fx_counters",
    ),
}
_QUANTITY_TEXTS = """
SELECT p_partkey,
       CASE p_partkey % 6 WHEN 0 THEN concat(cast(p_size AS string), 'm')
            WHEN 1 THEN cast(p_retailprice AS string) WHEN 2 THEN concat('  ', cast(p_size AS string), ' ')
            WHEN 3 THEN concat('-', cast(p_size AS string), '.5m') WHEN 4 THEN p_name ELSE concat(cast(p_size AS string), 'M') END AS cpu_text,
       CASE p_partkey % 8 WHEN 0 THEN concat(cast(p_size AS string), 'Mi')
            WHEN 1 THEN concat(cast(p_retailprice AS string), 'Ki') WHEN 2 THEN concat(' ', cast(p_size AS string), 'k ')
            WHEN 3 THEN concat(cast(p_size AS string), '.25Gi') WHEN 4 THEN p_type WHEN 5 THEN concat('-', cast(p_size AS string), 'M')
            WHEN 6 THEN concat(cast(p_size AS string), 'd') ELSE cast(p_size * 1003 AS string) END AS mem_text
FROM part"""
ORACLES["parse_quantities"] = (
    f"SELECT p_partkey, {cpu('cpu_text')} AS cpu_millis, {memory('mem_text')} AS memory_bytes FROM ({_QUANTITY_TEXTS})"
)


def streamed(width: str, exact: bool = False) -> str:
    """Buckets of ``width``, closed and open, once the last sample has been seen."""
    p50 = "quantile_disc(cpu_nano, 0.5)" if exact else "sum(cpu_nano) / count(*)"
    p95, p99 = (f"quantile_disc(cpu_nano, {q})" if exact else "max(cpu_nano)" for q in (0.95, 0.99))
    return with_views(
        f"""
SELECT {KEYS}, time_bucket({width}, ts) AS bucket_start, count(*) AS sample_count, round(CAST({p50} AS DOUBLE), 3) AS cpu_p50,
       CAST({p95} AS DOUBLE) AS cpu_p95, CAST({p99} AS DOUBLE) AS cpu_p99, CAST(max(cpu_nano) AS DOUBLE) AS cpu_max
FROM fx_dense GROUP BY {KEYS}, time_bucket({width}, ts)""",
        "fx_dense",
    )


ORACLES["stream_fine_buckets"] = streamed("INTERVAL 6 HOUR")
ORACLES["stream_fine_buckets_exact"] = streamed("INTERVAL 6 HOUR", exact=True)
ORACLES["stream_coarse_buckets"] = streamed("INTERVAL 1 DAY")
ORACLES["silver_published"] = f"SELECT * FROM ({streamed('INTERVAL 12 HOUR')}) WHERE bucket_start >= TIMESTAMP '2024-01-20'"
ORACLES["silver_summary"] = with_views(
    f"SELECT s.*, w.data_window_ns FROM (SELECT {KEYS}, {merged()} FROM fine_rows GROUP BY {KEYS}) s JOIN ({WINDOWS}) w USING ({KEYS})",
    "fx_dense",
    fine_rows=fine_rows("fx_dense", "incremental", "2024-01-29 00:00:00", raw="INTERVAL 12 HOUR"),
)
ORACLES["silver_exact_summary"] = with_views(
    f"SELECT s.*, w.data_window_ns FROM (SELECT {KEYS}, {merged()} FROM fine_rows GROUP BY {KEYS}) s JOIN ({WINDOWS}) w USING ({KEYS})",
    "fx_dense",
    fine_rows=fine_rows("fx_dense", "exact", "2024-01-29 00:00:00", raw="INTERVAL 12 HOUR"),
)
ORACLES["periodic_report"] = ORACLES["node_waste"]
ORACLES["periodic_report_pods"] = ORACLES["pod_waste"]
ORACLES["stream_coarse_closed"] = f"""
SELECT * FROM ({streamed('INTERVAL 1 DAY')}) WHERE bucket_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"""
#: The last change at or before a sample; before all of them the first one.
ORACLES["ingested_samples"] = with_views(
    f"""
SELECT {KEYS}, ts, seq, cpu_nano, mem_usage, mem_ws,
       coalesce(CASE WHEN n = 0 THEN first_cpu ELSE last_cpu END, 0) AS cpu_request_millis,
       coalesce(CASE WHEN n = 0 THEN first_mem ELSE last_mem END, 0) AS mem_request_bytes
FROM (SELECT s.*, count(c.seq) FILTER (WHERE c.ts <= s.ts) AS n,
             arg_max(c.cpu_request_millis, (c.ts, c.seq)) FILTER (WHERE c.ts <= s.ts) AS last_cpu,
             arg_max(c.mem_request_bytes, (c.ts, c.seq)) FILTER (WHERE c.ts <= s.ts) AS last_mem,
             any_value(f.cpu_request_millis) AS first_cpu, any_value(f.mem_request_bytes) AS first_mem
      FROM fx_samples s
      LEFT JOIN fx_spec_changes c USING (pod_namespace, pod_name, container_name)
      LEFT JOIN (SELECT * FROM fx_spec_changes
                 QUALIFY row_number() OVER (PARTITION BY pod_namespace, pod_name, container_name ORDER BY ts, seq DESC) = 1) f
      USING (pod_namespace, pod_name, container_name)
      GROUP BY s.node_name, s.pod_namespace, s.pod_name, s.container_name, s.ts, s.seq, s.cpu_nano, s.mem_usage, s.mem_ws)""",
    "fx_samples",
    "fx_spec_changes",
)
ORACLES["rejected_documents"] = with_views(
    """
SELECT node_name AS kind, count(*) AS n FROM fx_samples WHERE seq % 7 <> 0 GROUP BY node_name
UNION ALL SELECT 'kept', count(*) FROM fx_samples WHERE seq % 7 = 0
UNION ALL SELECT 'rejected', count(*) FROM fx_samples WHERE seq % 7 = 0
UNION ALL SELECT 'landed', count(*) FROM fx_samples""",
    "fx_samples",
)
ORACLES["argo_documents"] = with_views("SELECT * FROM fx_argo_resources", "fx_argo_resources")
ORACLES["flux_documents"] = with_views("SELECT * FROM fx_flux_inventory", "fx_flux_inventory")
ORACLES["repository_documents"] = with_views("SELECT * FROM fx_git_repos", "fx_git_repos")
ORACLES["recommendation_documents"] = recs(
    """
SELECT pod_namespace || '/' || owner_kind || '/' || owner_name AS target, container_name, resource, current_request, recommended_request,
       recommended_limit, risk, est_savings FROM recs"""
)
ORACLES["workload_rows"] = waste(
    """
SELECT pod_name, container_name, CAST(round_even(cpu_p95_millis, 0) AS BIGINT) AS cpu_p95_millis,
       CAST(round_even(mem_p95_bytes / 1e6, 0) AS BIGINT) AS mem_p95_mb
FROM container_waste WHERE pod_namespace = 'ns-1' AND owner_kind = 'Deployment' AND owner_name = 'app-1'"""
)
ORACLES["cluster_report_recommendations"] = recs(
    "SELECT pod_namespace, owner_kind || '/' || owner_name AS target, container_name, resource, recommended_request, risk FROM recs"
)
