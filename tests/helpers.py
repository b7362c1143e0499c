"""Small builders and an independent model of the tier rules."""

from __future__ import annotations

import math
from collections import defaultdict
from datetime import datetime, timedelta, timezone

SAMPLE_DDL = (
    "node_name string, pod_namespace string, pod_name string, container_name string, "
    "ts timestamp_ntz, seq bigint, cpu_nano bigint, mem_usage bigint, mem_ws bigint"
)
T0 = datetime(2026, 2, 28, 12, 0, 0)
METADATA = dict(
    cpu_request_millis=0, cpu_limit_millis=0, mem_request_bytes=0, mem_limit_bytes=0,
    restart_count=0, qos_class="", owner_kind="", owner_name="",
)
METADATA_DDL = (
    "cpu_request_millis bigint, cpu_limit_millis bigint, mem_request_bytes bigint, "
    "mem_limit_bytes bigint, restart_count int, qos_class string, owner_kind string, owner_name string"
)


def samples(spark, rows, pod="p", ns="ns", container="c", node="n1"):
    """``rows``: (time, cpu) pairs; memory follows the CPU value."""
    data = [
        (node, ns, pod, container, at, i, int(v), int(v) * 2, int(v) * 3)
        for i, (at, v) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SAMPLE_DDL)


def nearest_rank(values, p):
    if not values:
        return 0
    ordered = sorted(values)
    return ordered[min(max(math.ceil(p * len(ordered)) - 1, 0), len(ordered) - 1)]


def floor(at, seconds):
    since = at.replace(tzinfo=timezone.utc).timestamp()
    return datetime.fromtimestamp(since - since % seconds, timezone.utc).replace(tzinfo=None)


class Replay:
    """Feeds samples one by one and keeps raw, fine and coarse state like a live agent would."""

    def __init__(self):
        self.raw, self.fine, self.coarse = [], {}, {}

    @staticmethod
    def _add(table, start, bucket):
        if start in table:
            a, b = table[start], bucket
            n = a["n"] + b["n"]
            bucket = dict(
                n=n,
                p50=a["p50"] * a["n"] / n + b["p50"] * b["n"] / n,
                **{k: max(a[k], b[k]) for k in ("p95", "p99", "max")},
            )
        table[start] = bucket

    @staticmethod
    def _bucket(values):
        return dict(
            n=len(values), max=max(values),
            **{f"p{q}": nearest_rank(values, q / 100) for q in (50, 95, 99)},
        )

    def record(self, at, value):
        self.raw.append((at, value))
        ready = [s for s in self.raw if s[0] < at - timedelta(minutes=5)]
        self.raw = [s for s in self.raw if s[0] >= at - timedelta(minutes=5)]
        groups = defaultdict(list)
        for t, v in ready:
            groups[floor(t, 300)].append(v)
        for start, values in groups.items():
            self._add(self.fine, start, self._bucket(values))
        for start in [s for s in self.fine if s < at - timedelta(hours=24)]:
            self._add(self.coarse, floor(start, 3600), self.fine.pop(start))
        for start in [s for s in self.coarse if s < at - timedelta(days=7)]:
            del self.coarse[start]

    def summary(self):
        buckets = [*self.coarse.values(), *self.fine.values()]
        if self.raw:
            buckets.append(self._bucket([v for _, v in self.raw]))
        n = sum(b["n"] for b in buckets)
        return dict(
            n=n,
            p50=sum(b["p50"] * b["n"] for b in buckets) / n,
            **{k: max(b[k] for b in buckets) for k in ("p95", "p99", "max")},
        )

    def window(self):
        starts = [*self.coarse, *self.fine, *[t for t, _ in self.raw]]
        ends = [
            *[s + timedelta(hours=1) for s in self.coarse],
            *[s + timedelta(minutes=5) for s in self.fine],
            *[t for t, _ in self.raw],
        ]
        return max(ends) - min(starts)
