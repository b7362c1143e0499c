import pytest
from pyspark.sql import functions as F

from trimline.functions import text
from trimline.functions.owners import deployment_name, resolve
from trimline.functions.quantities import cpu_millis, format_cpu, format_memory, memory_bytes, register_sql
from trimline.schemas import OWNER_REFERENCES

CPU = [
    ("500m", 500), ("100m", 100), ("1000m", 1000), ("1", 1000), ("2", 2000), ("2.5", 2500), ("0.5", 500),
    ("0.1", 100), ("0.5m", 0), ("0m", 0), ("0", 0), ("  500m", 500), ("500m  ", 500), ("  500m  ", 500),
    ("  2  ", 2000), ("", 0), ("   ", 0), ("abc", 0), ("m", 0), ("!@#", 0), ("-100m", -100), ("-1", -1000),
    ("999999m", 999999), ("999999999", 999999999000), ("500M", 0), ("5d", 0), ("5f", 0), ("1e3m", 1000),
    ("\t1\n", 1000), (".5", 500), ("5.", 5000), ("99999999999999999999", 0), (None, 0), ("1 m", 0), ("+1", 1000),
]
MEMORY = [
    ("256Mi", 268435456), ("1Gi", 1 << 30), ("512Ki", 524288), ("1Ti", 1 << 40), ("1Pi", 1 << 50), ("1Ei", 1 << 60),
    ("1k", 1000), ("1M", 10**6), ("1G", 10**9), ("1T", 10**12), ("1P", 10**15), ("1E", 10**18), ("1048576", 1048576),
    ("0", 0), ("0Mi", 0), ("0Gi", 0), ("0Ki", 0), ("  256Mi", 268435456), ("256Mi  ", 268435456), ("", 0), ("   ", 0),
    ("abc", 0), ("Mi", 0), ("Ki", 0), ("-256Mi", -268435456), ("-1Gi", -(1 << 30)), ("256k", 256000), ("256Ki", 262144),
    ("256K", 0), ("999999999", 999999999), ("100m", 0), ("1.5Gi", 1610612736), ("0.1Ki", 102), ("1e3", 1000),
    ("1E3", 1000), ("100E", 0), ("7d", 0), (None, 0), ("1 Gi", 0),
]


def one_by_one(spark, cases, column):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, q string")
    return [r.v for r in df.select("i", column(F.col("q")).alias("v")).orderBy("i").collect()]


def test_quantities(spark):
    assert one_by_one(spark, CPU, cpu_millis) == [v for _, v in CPU]
    assert one_by_one(spark, MEMORY, memory_bytes) == [v for _, v in MEMORY]


def test_sql_functions_agree(spark):
    register_sql(spark)
    assert one_by_one(spark, CPU, lambda q: F.call_function("cpu_millis", q)) == [v for _, v in CPU]
    assert one_by_one(spark, MEMORY, lambda q: F.call_function("memory_bytes", q)) == [v for _, v in MEMORY]
    row = spark.sql("SELECT format_cpu(1500L) a, format_cpu(2000L) b, format_memory(2147483648L) c, format_memory(1610612736L) d, format_memory(5L) e").first()
    assert list(row) == ["1500m", "2", "2Gi", "1536Mi", "5"]


@pytest.mark.parametrize(
    "function, cases",
    [
        (format_cpu, {0: "0", 50: "50m", 250: "250m", 1000: "1", 2000: "2", 1500: "1500m"}),
        (format_memory, {67108864: "64Mi", 134217728: "128Mi", 536870912: "512Mi", 1 << 30: "1Gi", 1 << 31: "2Gi",
                         1610612736: "1536Mi", (1 << 20) + 5: "1Mi", 1000: "1000", 0: "0"}),
    ],
)
def test_formats(spark, function, cases):
    df = spark.createDataFrame([(k,) for k in cases], "v bigint")
    assert {r.v: r.s for r in df.select("v", function(F.col("v")).alias("s")).collect()} == cases


OWNERS = [
    (None, "", ""),
    ([], "", ""),
    ([("ReplicaSet", "web-app-7f8b9c5d6e", True)], "Deployment", "web-app"),
    ([("StatefulSet", "redis", True)], "StatefulSet", "redis"),
    ([("DaemonSet", "fluentd", True)], "DaemonSet", "fluentd"),
    ([("ReplicaSet", "api-abc123", None)], "Deployment", "api"),
    ([("Node", "node-1", None), ("ReplicaSet", "backend-6d5f4c3b2a", True)], "Deployment", "backend"),
    ([("ReplicaSet", "standaloners", True)], "ReplicaSet", "standaloners"),
    ([("Job", "a", False), ("", "x", True)], "Job", "a"),
    ([("Job", "first", True), ("Job", "second", True)], "Job", "first"),
]


def test_owner_resolution(spark):
    df = spark.createDataFrame([(i, refs) for i, (refs, *_) in enumerate(OWNERS)], f"i int, refs {OWNER_REFERENCES.simpleString()}")
    got = df.select("i", resolve(F.col("refs")).alias("o")).orderBy("i").collect()
    assert [(r.o.kind, r.o.name) for r in got] == [(k, n) for _, k, n in OWNERS]


def test_deployment_names(spark):
    cases = {"web-app-7f8b9c5d6e": "web-app", "api-abc123": "api", "nohyphen": "", "-leadinghyphen": "", "a-b": "a", "a-": "a"}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r.n: r.d for r in df.select("n", deployment_name(F.col("n")).alias("d")).collect()} == cases


def test_inventory_ids(spark):
    cases = {
        "default_nginx_apps_Deployment": ("default", "nginx", "Deployment"),
        "ns_my_long_name_apps_StatefulSet": ("ns", "my_long_name", "StatefulSet"),
        "ns_svc__Service": ("ns", "svc", "Service"),
        "a_b_c": None, "plain": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "id string")
    got = {r.id: r.p and tuple(r.p) for r in df.select("id", text.parse_inventory_id(F.col("id")).alias("p")).collect()}
    assert got == cases


def test_series_keys(spark):
    df = spark.createDataFrame([("ns/pod/c",), ("ns/pod/c/d",), ("ns/pod",), ("x",)], "k string")
    got = {r.k: r.p and tuple(r.p) for r in df.select("k", text.split_series_key(F.col("k")).alias("p")).collect()}
    assert got == {"ns/pod/c": ("ns", "pod", "c"), "ns/pod/c/d": ("ns", "pod", "c/d"), "ns/pod": None, "x": None}


def test_paths(spark):
    cases = {"apps/x.yaml": False, "a/../b": False, "../x": True, "../../../etc/passwd": True, "": True, ".": True,
             "a/..": True, "a/../..": True, "./a": False, "a//b": False, "a/../../a/b": True}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.e for r in df.select("p", text.escapes_root(F.col("p")).alias("e")).collect()} == cases


def test_whole_percent_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (0.92,)], "c double")
    assert [r[0] for r in df.select(text.whole_percent(F.col("c"))).collect()] == [12, 38, 92]


def test_branch_and_title(spark):
    row = spark.range(1).select(
        text.branch_name(F.lit("fix"), F.lit("prod"), F.lit("api"), F.lit("2026-03-04 05:06:07").cast("timestamp")).alias("b"),
        text.change_title(F.lit("StatefulSet"), F.lit("redis")).alias("t"),
    ).first()
    assert (row.b, row.t) == ("fix/prod-api-20260304-050607", "chore: right-size statefulset/redis resources")


@pytest.mark.parametrize("limit, rows", [(500, ["| CPU request | 1 | 250m |", "| CPU limit | 2 | 500m |"]), (0, ["| CPU request | 1 | 250m |"])])
def test_change_body(spark, limit, rows):
    values = dict(kind="Deployment", name="api", namespace="prod", pattern="steady", confidence=0.92, risk="LOW", resource="cpu",
                  current_request=1000, recommended_request=250, current_limit=2000, recommended_limit=limit, reasoning="why")
    body = spark.range(1).select(text.change_body(**{k: F.lit(v) for k, v in values.items()}, footer="made here")).first()[0]
    lines = body.split("\n")
    assert lines[0] == "## Right-sizing: Deployment/api" and lines[-3:] == ["---", "made here", ""]
    assert "**Confidence:** 92%" in lines and [x for x in lines if x.startswith("| CPU")] == rows
