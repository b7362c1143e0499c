import json
import random
from datetime import timedelta

from pyspark.sql import functions as F

from tests.helpers import T0, samples
from tests.test_streaming import land, pod_list, run, usage
from trimline.schemas import METADATA_DEFAULTS, SPEC_KEY
from trimline.streaming.ingest import start_ingest
from trimline.streaming.specs import SpecHistory, enrich_valid, start_specs

DDL = (
    "pod_namespace string, pod_name string, container_name string, cpu_request_millis bigint, cpu_limit_millis bigint, "
    "mem_request_bytes bigint, mem_limit_bytes bigint, restart_count int, qos_class string, owner_kind string, owner_name string, "
    "scraped_at timestamp, seq bigint"
)


def specs(spark, rows):
    data = [("ns", pod, "c", cpu, 0, 0, 0, 0, "", "", "", at, seq) for pod, at, seq, cpu in rows]
    return spark.createDataFrame(data, DDL)


def test_history_equals_brute_force_whatever_the_batches(spark, tmp_path):
    rng = random.Random(2)
    points = [(f"p{rng.randint(0, 3)}", T0 + timedelta(minutes=rng.randint(0, 40)), i, rng.choice([100, 200])) for i in range(120)]
    history = SpecHistory(spark, str(tmp_path / "specs"), compact_every=2)
    for version in range(4):  # late lists included: points are in no order
        history.update(specs(spark, points[version * 30 : version * 30 + 30]), version)
    history.update(specs(spark, points[90:]), 3)  # a replay
    found = history.read()
    for pod in {p for p, *_ in points}:
        last = {}
        for _, at, seq, cpu in sorted(p for p in points if p[0] == pod):
            last[at] = cpu
        expected, before = [], None
        for at in sorted(last):
            if last[at] != before:
                expected.append((at, last[at]))
            before = last[at]
        got = sorted((r.valid_from, r.cpu_request_millis, r.valid_to) for r in found.filter(F.col("pod_name") == pod).collect())
        assert [g[:2] for g in got] == expected
        assert [g[2] for g in got] == [*[at for at, _ in expected[1:]], None]
    assert len(history.table.parts()) <= 2


def test_unchanged_specs_cost_few_points(spark, tmp_path):
    history = SpecHistory(spark, str(tmp_path / "specs"), late_seconds=60, compact_every=1)
    for version in range(3):
        rows = [("p", T0 + timedelta(seconds=30 * (100 * version + i)), i, 100 + version // 2) for i in range(100)]
        history.update(specs(spark, rows), version)
    assert history.read().count() == 2
    assert history.table.read().count() == 3 + 3  # ends of the two intervals, and the last minute


def test_samples_take_the_spec_of_their_time(spark, tmp_path):
    history = SpecHistory(spark, str(tmp_path / "specs"))
    assert history.read() is None
    history.update(specs(spark, [("p", T0, 0, 100), ("p", T0 + timedelta(minutes=10), 1, 300)]), 0)
    at = [(T0 + timedelta(minutes=m), m) for m in (-5, 0, 9, 10, 60)]
    rows = samples(spark, at).unionByName(samples(spark, at[:1], pod="other")).withColumn("ts", F.col("ts").cast("timestamp"))
    got = enrich_valid(rows, history.read())
    assert got.columns == [*rows.columns, *METADATA_DEFAULTS]
    assert [r.cpu_request_millis for r in got.filter("pod_name = 'p'").orderBy("ts").collect()] == [100, 100, 100, 300, 300]
    assert got.filter("pod_name = 'other'").first().cpu_request_millis == 0


def test_old_intervals_go_when_the_table_is_compacted(spark, tmp_path):
    history = SpecHistory(spark, str(tmp_path / "specs"), keep_seconds=3600, compact_every=1)
    for version in range(3):
        history.update(specs(spark, [("p", T0 + timedelta(hours=version), version, 100 * version)]), version)
    assert sorted(r.cpu_request_millis for r in history.read().collect()) == [0, 100, 200]
    history.update(specs(spark, [("q", T0 + timedelta(hours=9), 0, 5)]), 3)
    assert sorted(r.cpu_request_millis for r in history.read().collect()) == [5, 200]


def test_ingest_with_spec_table_and_rejects(spark, tmp_path):
    bronze, table, rejects = (str(tmp_path / n) for n in ("bronze", "specs", "rejects"))
    for i, (cpu, minutes) in enumerate([("500m", 0), ("1", 1)]):
        document = pod_list(cpu) | {"scraped_at": (T0 + timedelta(minutes=minutes)).isoformat() + "Z"}
        land(tmp_path / "pods", f"{i}.json", [document])
        run(start_specs(spark, str(tmp_path / "pods"), table, str(tmp_path / "cp1"), None))
    documents = [usage(T0 + timedelta(seconds=s), s) for s in (0, 30, 60, 90)]
    land(tmp_path / "usage", "a.json", [*documents, "{broken", json.dumps(documents[0])[:-9]])
    run(start_ingest(spark, str(tmp_path / "usage"), None, bronze, str(tmp_path / "cp2"), None, spec_table=table, rejects_path=rejects))
    rows = spark.read.parquet(bronze).orderBy("ts").collect()
    assert [r.cpu_request_millis for r in rows] == [500, 500, 1000, 1000]
    assert {r.owner_name for r in rows} == {"web"}
    assert spark.read.parquet(rejects).filter("_corrupt_record is not null").count() == 2
    counts = spark.read.parquet(f"{rejects}-counts").agg(F.sum("landed").alias("landed"), F.sum("rejected").alias("rejected"))
    assert tuple(counts.first()) == (6, 2)


def test_keys_are_those_of_specs():
    assert tuple(SPEC_KEY) == ("pod_namespace", "pod_name", "container_name")
