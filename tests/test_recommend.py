import random
from dataclasses import replace
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import T0, samples
from trimline.operators import changes, counters, recommend
from trimline.params import Sizing, Tiering
from trimline.plans import rightsize, views

SPEC_DDL = (
    "pod_namespace string, pod_name string, container_name string, cpu_request string, cpu_limit string, "
    "mem_request string, mem_limit string, restart_count int, qos_class string, owner_kind string, owner_name string"
)
SHAPES = {
    # millicores per hour of the week
    "steady": lambda h: 300 + h % 3,
    "burstable": lambda h: 900 if h % 24 == 12 else 200,
    "batch": lambda h: 1500 if h % 24 < 2 else 2,
    "idle": lambda h: 1,
    "anomalous": lambda h: 300 + h % 3,
}


def week(spark, shape, pod):
    rows = []
    for h in range(7 * 24):
        for i in range(12):
            rows.append((T0 + timedelta(hours=h, minutes=5 * i), SHAPES[shape](h) * 1_000_000))
    frame = samples(spark, rows, pod=pod)
    if shape == "anomalous":
        growing = F.unix_micros(F.col("ts").cast("timestamp")) / 1000 - F.lit(int(T0.timestamp()) * 1000)
        return frame.withColumn("mem_ws", (F.lit(10**8) + growing).cast("bigint"))
    return frame.withColumn("mem_ws", F.lit(10**8) + F.col("seq") % 7 * 1000)


@pytest.fixture(scope="module")
def recs(spark):
    frame = None
    specs = []
    for shape in SHAPES:
        part = week(spark, shape, f"{shape}-5d-x")
        frame = part if frame is None else frame.unionByName(part)
        specs.append(("ns", f"{shape}-5d-x", "c", "2", "4", "1Gi", "2Gi", 0, "Burstable", "ReplicaSet", f"{shape}-5d"))
    # a batch job idles for less than 48 hours at a time
    result = rightsize.recommend(frame, spark.createDataFrame(specs, SPEC_DDL), Tiering(), Sizing())
    return result.cache()


def test_patterns(recs):
    assert {r.owner_name: r.pattern for r in recs.select("owner_name", "pattern").distinct().collect()} == {s: s for s in SHAPES}


def test_safety_limits_and_savings(recs):
    s = Sizing()
    for r in recs.collect():
        assert r.recommended_request > 0
        assert r.est_savings == r.current_request - r.recommended_request
        assert 0 <= r.confidence <= 1 and r.risk in recommend.RISKS
        assert r.recommended_limit == 0 or r.recommended_limit >= r.recommended_request
        if r.resource == "cpu":
            assert r.recommended_request >= s.cpu_floor_millis
        else:
            assert r.recommended_request >= s.memory_floor_bytes
        if r.pattern in ("idle", "anomalous"):
            assert r.recommended_request == r.current_request and "flagged" in r.reasoning


def classified(spark, **columns):
    base = dict(
        pod_namespace="ns", owner_kind="Deployment", owner_name="a", container_name="c", pattern="steady", n=5000,
        data_window_ns=7 * 86_400 * 10**9, cpu_p50=1e8, cpu_p95=1e8, cpu_p99=1e8, cpu_max=1e8, ws_p50=1e8, ws_p95=1e8, ws_p99=1e8,
        ws_max=1e8, cpu_request_millis=1000, cpu_limit_millis=0, mem_request_bytes=10**9, mem_limit_bytes=0,
    )
    return spark.createDataFrame([base | columns])


def sized(spark, sizing=Sizing(), **columns):
    return {r.resource: r for r in recommend.recommendations(classified(spark, **columns), sizing).collect()}


def test_limits_win_over_the_cap_and_the_cap_over_the_proposal(spark):
    capped = sized(spark)
    assert capped["cpu"].recommended_request == 500 and capped["memory"].recommended_request == 5 * 10**8
    tiny = sized(spark, cpu_request_millis=20, mem_request_bytes=1000, cpu_p95=1.0, ws_p99=1.0, ws_p95=1.0)
    assert tiny["cpu"].recommended_request == 50 and tiny["memory"].recommended_request == 64 * 1024 * 1024
    hungry = sized(spark, ws_p99=3e9 + 1)
    assert hungry["memory"].recommended_request >= (3e9 + 1) * 1.1 and hungry["memory"].est_savings < 0
    flagged = sized(spark, pattern="idle", cpu_request_millis=10)
    assert flagged["cpu"].recommended_request == 50 and flagged["memory"].recommended_request == 10**9


def test_higher_confidence_allows_larger_reductions(spark):
    sizes = [sized(spark, data_window_ns=int(share * 7 * 86_400 * 1e9), n=int(5000 * share)) for share in (0.05, 0.25, 1.0)]
    requests = [s["cpu"].recommended_request for s in sizes]
    assert requests == sorted(requests, reverse=True) and requests[0] > requests[-1]
    confidences = [s["cpu"].confidence for s in sizes]
    assert confidences == sorted(confidences)
    assert sizes[0]["cpu"].risk == "HIGH"


def test_result_does_not_depend_on_the_split_path(spark):
    frame = week(spark, "burstable", "b-5d-x").unionByName(week(spark, "steady", "s-5d-x"))
    specs = spark.createDataFrame([("ns", "b-5d-x", "c", "2", "4", "1Gi", "", 0, "", "", "")], SPEC_DDL)
    ordinary, split = (
        rightsize.recommend(frame, specs, replace(Tiering(), hot_rows=h), Sizing()).orderBy("owner_name", "resource").collect()
        for h in (10**6, 100)
    )
    assert ordinary == split


def flat(spark, rows):
    ddl = "pod_namespace string, owner_kind string, owner_name string, container_name string, resource string, est_savings bigint, confidence double, risk string, pattern string, seq int"
    return spark.createDataFrame(rows, ddl)


RECS = [
    ("ns", "Deployment", "a", "c", "memory", 16, 0.9, "LOW", "steady", 0),
    ("ns", "deployment", "a", "c", "cpu", 17, 0.8, "MEDIUM", "steady", 1),
    ("ns", "Deployment", "a", "d", "cpu", 99, 0.7, "HIGH", "idle", 2),
    ("ns", "Deployment", "b", "c", "memory", 5, 0.6, "low", "odd", 3),
    ("other", "Deployment", "a", "c", "memory", 7, 0.5, "LOW", "batch", 4),
]


def test_filters_ranking_and_choice(spark):
    frame = flat(spark, RECS)
    assert recommend.filter_recommendations(frame, risk="low").count() == 3
    assert recommend.filter_recommendations(frame, risk="LOW", namespace="other").count() == 1
    assert recommend.filter_recommendations(frame).count() == 5
    assert [r.est_savings for r in recommend.by_savings(frame).collect()] == [99, 17, 16, 7, 5]
    assert [r.confidence for r in recommend.by_confidence(frame).collect()] == [0.9, 0.8, 0.7, 0.6, 0.5]
    chosen = {(r.pod_namespace, r.owner_name): r.seq for r in recommend.one_per_target(frame, ["seq"]).collect()}
    assert chosen == {("ns", "a"): 1, ("ns", "b"): 3, ("other", "a"): 4}
    good, bad = recommend.valid_recommendations(frame)
    assert (good.count(), bad.count()) == (4, 1)
    assert {r.resource: r.est_savings for r in recommend.savings_by_resource(frame).collect()} == {"cpu": 116, "memory": 28}


def test_digest(spark):
    rows = [(*r[:5], r[5], r[8], T0 + timedelta(minutes=m), i) for i, (r, m) in enumerate(
        [(RECS[0], 0), (RECS[0], 10), (RECS[0], 70), (RECS[2], 5), ((*RECS[3][:5], -4, 0.1, "LOW", "steady", 9), 5)])]
    frame = spark.createDataFrame(rows, "pod_namespace string, owner_kind string, owner_name string, container_name string, resource string, est_savings bigint, pattern string, ts timestamp_ntz, seq int")
    assert sorted(r.seq for r in recommend.digest(frame).collect()) == [0, 2, 3]
    assert [r.seq for r in recommend.digest(frame, "warning").collect()] == [3]
    assert recommend.digest(frame, "info").count() == 4


def test_change_requests(spark, recs):
    sources = spark.createDataFrame(
        [("ns", "Deployment", "steady", "git.example/r", "a.yaml", "", None), ("ns", "deployment", "batch", "", "", "", "missing")],
        "namespace string, kind string, name string, repo string, path string, field string, annotation_error string",
    )
    rows = {r.owner_name: r for r in changes.change_requests(recs, sources, ["container_name"], "2026-03-04 05:06:07").collect()}
    assert set(rows) == {"steady", "batch"}
    assert rows["steady"].resource == "cpu" and rows["steady"].branch == "right-size/ns-steady-20260304-050607"
    assert rows["batch"].error == "missing" and rows["steady"].title == "chore: right-size deployment/steady resources"
    table = views.recommendations_table(recommend.by_savings(recs)).first()
    assert table.target.startswith("ns/") and table.resource == "memory"


@pytest.mark.parametrize("chunk", [10, 60, 300])
def test_counter_increase_with_resets(spark, chunk):
    rng, value, rows = random.Random(4), 0, []
    for i in range(500):
        value = 0 if rng.random() < 0.05 else value + rng.randrange(5)
        rows.append(("m", "a", T0 + timedelta(seconds=7 * i), i, float(value)))
    frame = spark.createDataFrame(rows, "metric string, label string, ts timestamp_ntz, seq int, value double")
    expected = {}
    for before, now in zip([None, *rows], rows):
        grown = 0 if before is None else (now[4] if now[4] < before[4] else now[4] - before[4])
        start = now[2] - timedelta(seconds=(now[2] - T0).seconds % 300)
        expected[start] = expected.get(start, 0) + grown
    got = counters.counter_increase(frame, ["label"], 300, chunk)
    assert {r.window_start: r.increase for r in got.collect()} == expected
    rate = counters.counter_rate(frame, ["label"], 300, chunk).orderBy("window_start").first().rate
    assert rate == pytest.approx(expected[T0] / 300)
    assert counters.latest_gauge(frame, ["label"]).first().value == rows[-1][4]
    assert counters.keep_metrics(frame, counters.KEPT_METRICS).count() == 0
    with pytest.raises(ValueError):
        counters.counter_increase(frame, ["label"], 300, 7)
