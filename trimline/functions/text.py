"""Names, keys and texts of a change request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trimline.functions.quantities import format_cpu, format_memory

WORKLOAD_KINDS = ("deployment", "statefulset", "daemonset")


def series_key(namespace: Column, pod: Column, container: Column) -> Column:
    return F.concat_ws("/", namespace, pod, container)


def split_series_key(key: Column) -> Column:
    """``struct(pod_namespace, pod_name, container_name)``; NULL for a malformed key."""
    parts = F.split(key, "/", 3)
    return F.when(
        F.size(parts) == 3,
        F.struct(
            parts[0].alias("pod_namespace"),
            parts[1].alias("pod_name"),
            parts[2].alias("container_name"),
        ),
    )


def is_workload_kind(kind: Column) -> Column:
    return F.lower(kind).isin(*WORKLOAD_KINDS)


def parse_inventory_id(entry_id: Column) -> Column:
    """``struct(namespace, name, kind)`` of ``namespace_name_group_kind``; NULL when too short.

    Only the name may contain underscores.
    """
    pattern = r"(?s)^([^_]*)_(.*)_([^_]*)_([^_]*)$"
    return F.when(
        entry_id.rlike(pattern),
        F.struct(
            F.regexp_extract(entry_id, pattern, 1).alias("namespace"),
            F.regexp_extract(entry_id, pattern, 2).alias("name"),
            F.regexp_extract(entry_id, pattern, 4).alias("kind"),
        ),
    )


def escapes_root(path: Column) -> Column:
    """True when a relative path leaves its root, or names the root itself."""
    depths = F.aggregate(
        F.split(path, "/"),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest")),
        lambda acc, part: F.struct(
            (acc["depth"] + _step(part)).alias("depth"),
            F.least(acc["lowest"], acc["depth"] + _step(part)).alias("lowest"),
        ),
    )
    return (depths["lowest"] < 0) | (depths["depth"] <= 0)


def _step(part: Column) -> Column:
    return F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)


def branch_name(prefix: Column, namespace: Column, name: Column, ts: Column) -> Column:
    stamp = F.date_format(ts, "yyyyMMdd-HHmmss")
    return F.concat(prefix, F.lit("/"), namespace, F.lit("-"), name, F.lit("-"), stamp)


# The texts of change requests, whose wording readers of the requests rely on.
CHANGE_TITLE = "chore: right-size %s/%s resources"
CHANGE_ROW = "| %s %s | %s | %s |"
CHANGE_BODY = """## Right-sizing: %s/%s

**Namespace:** %s
**Pattern:** %s
**Confidence:** %s%%
**Risk:** %s

### Changes

| Resource | Current | Recommended |
|----------|---------|-------------|
%s

**Reasoning:** %s

---
%s
"""


def change_title(kind: Column, name: Column) -> Column:
    return F.format_string(CHANGE_TITLE, F.lower(kind), name)


def whole_percent(share: Column) -> Column:
    """Share as a whole percent, ties to even."""
    return F.rint(share * 100).cast("bigint")


def change_body(
    *,
    kind: Column,
    name: Column,
    namespace: Column,
    pattern: Column,
    confidence: Column,
    risk: Column,
    resource: Column,
    current_request: Column,
    recommended_request: Column,
    current_limit: Column,
    recommended_limit: Column,
    reasoning: Column,
    footer: str,
) -> Column:
    """Markdown description of one recommendation, closed by ``footer``."""

    is_cpu = resource == "cpu"

    def shown(value: Column) -> Column:
        return F.when(is_cpu, format_cpu(value)).otherwise(format_memory(value))

    def row(what: str, before: Column, after: Column) -> Column:
        label = F.when(is_cpu, "CPU").otherwise("Memory")
        return F.format_string(CHANGE_ROW, label, F.lit(what), shown(before), shown(after))

    # concat_ws skips NULLs, so the limit row is simply left out when there is no limit
    rows = F.concat_ws(
        "\n",
        row("request", current_request, recommended_request),
        F.when(recommended_limit > 0, row("limit", current_limit, recommended_limit)),
    )
    percent = whole_percent(confidence)
    parts = [kind, name, namespace, pattern, percent, risk, rows, reasoning, F.lit(footer)]
    return F.format_string(CHANGE_BODY, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
