import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import T0, nearest_rank, samples
from trimline.operators.buckets import buckets
from trimline.operators.series import latest_metadata, series_summary
from trimline.params import EXACT, INCREMENTAL, Tiering
from trimline.sources.bronze import read_samples, read_tail, write_samples
from trimline.sources.reports import latest_per_node
from trimline.streaming.buckets import coarse_stream, fine_stream, read_ranked, start_buckets, value_stream
from trimline.streaming.ingest import start_ingest, trigger_of
from trimline.streaming.reports import start_reports
from trimline.streaming.silver import (
    compact,
    drop_days_before,
    read_silver,
    start_silver,
    summary_from_silver,
)


def series_rows(n=400, step=90, start=T0):
    return [(start + timedelta(seconds=step * i + i % 7), (i * 7919) % 1000 * 1000) for i in range(n)]


def land(path, name, documents):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in documents))


def usage(at, cpu, pod="web-abc-x"):
    container = {"name": "main", "cpu": {"usageNanoCores": cpu}, "memory": {"usageBytes": 5, "workingSetBytes": 4}}
    return {
        "node": {"nodeName": "n1"},
        "scraped_at": at.isoformat() + "Z",
        "pods": [{"podRef": {"name": pod, "namespace": "ns"}, "containers": [container]}],
    }


def pod_list(cpu):
    return {
        "scraped_at": T0.isoformat() + "Z",
        "items": [
            {
                "metadata": {"name": "web-abc-x", "namespace": "ns",
                             "ownerReferences": [{"kind": "ReplicaSet", "name": "web-abc", "controller": True}]},
                "spec": {"containers": [{"name": "main", "resources": {"requests": {"cpu": cpu, "memory": "1Gi"}}}]},
                "status": {"qosClass": "Burstable", "containerStatuses": [{"name": "main", "restartCount": 2}]},
            }
        ],
    }


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_interval_has_a_floor():
    assert trigger_of(1) == {"processingTime": "100 milliseconds"}
    assert trigger_of(None) == {"availableNow": True}


def test_ingest_enriches_skips_bad_documents_and_replays_safely(spark, tmp_path):
    land(tmp_path / "usage", "a.json", [usage(T0, 150_000_000), "{broken", usage(T0 + timedelta(seconds=30), 2)])
    land(tmp_path / "pods", "a.json", [pod_list("500m")])
    bronze = str(tmp_path / "bronze")
    run(start_ingest(spark, str(tmp_path / "usage"), str(tmp_path / "pods"), bronze, str(tmp_path / "cp"), None))
    rows = spark.read.parquet(bronze)
    assert rows.count() == 2
    row = rows.orderBy("ts").first()
    assert (row.cpu_request_millis, row.owner_kind, row.owner_name, row.restart_count) == (500, "Deployment", "web", 2)

    # a later spec applies to later batches only
    land(tmp_path / "usage", "b.json", [usage(T0 + timedelta(seconds=60), 3)])
    land(tmp_path / "pods", "b.json", [pod_list("1") | {"seq": 1}])
    run(start_ingest(spark, str(tmp_path / "usage"), str(tmp_path / "pods"), bronze, str(tmp_path / "cp"), None))
    requests = [r.cpu_request_millis for r in spark.read.parquet(bronze).orderBy("ts").collect()]
    assert requests == [500, 500, 1000]

    # the same batches from a fresh checkpoint overwrite what they wrote before
    before = spark.read.parquet(bronze).filter("batch_id = 0").count()
    run(start_ingest(spark, str(tmp_path / "usage"), str(tmp_path / "pods"), bronze, str(tmp_path / "cp2"), None))
    assert before == 2
    assert spark.read.parquet(bronze).filter("batch_id = 0").count() == 3


def test_ingest_without_specs_keeps_samples(spark, tmp_path):
    land(tmp_path / "usage", "a.json", [usage(T0, 7)])
    bronze = str(tmp_path / "bronze")
    run(start_ingest(spark, str(tmp_path / "usage"), str(tmp_path / "none"), bronze, str(tmp_path / "cp"), None))
    row = spark.read.parquet(bronze).first()
    assert (int(row.cpu_nano), row.cpu_request_millis, row.owner_kind) == (7, 0, "")


@pytest.mark.parametrize("mode", [EXACT, INCREMENTAL])
def test_stream_buckets_equal_batch_buckets(spark, tmp_path, mode):
    rows = series_rows()
    path = str(tmp_path / "in")
    samples(spark, rows).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    # one sample far ahead closes every window before it
    samples(spark, [(T0 + timedelta(days=30), 1)]).withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(path)
    t = Tiering(mode=mode)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    name = f"fine_{mode}"
    query = (
        fine_stream(stream, t, "1 hour").writeStream.format("memory").queryName(name)
        .outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    run(query)
    closed = spark.table(name).select("*", F.col("w.start").cast("timestamp_ntz").alias("start"))
    got = {
        (r.start, r.n, r.cpu_p95, round(r.cpu_p50, 6))
        for r in closed.collect() if r.start < T0 + timedelta(days=1)
    }
    # a clock just after the data keeps all of it in fine buckets
    batch = buckets(samples(spark, rows), Tiering(mode=mode, as_of=T0 + timedelta(hours=12)))
    expected = {(r.bucket_start, r.sample_count, r.cpu_p95, round(r.cpu_p50, 6)) for r in batch.filter("tier = 'fine'").collect()}
    assert got == expected and len(got) > 100


def test_exact_ranks_of_a_huge_bucket_from_counted_values(spark, tmp_path):
    """A million samples in one window of one series: the state is a row per distinct value, no array."""
    n, path = 1_000_000, str(tmp_path / "in")
    key = {"node_name": "n", "pod_namespace": "ns", "pod_name": "p", "container_name": "c"}
    value = (F.col("id") * 7919) % 1013
    spark.range(n).select(
        *[F.lit(v).alias(k) for k, v in key.items()], (F.lit(T0).cast("timestamp") + F.make_dt_interval(secs=F.col("id") % 299)).alias("ts"),
        value.alias("cpu_nano"), (value * 2).alias("mem_usage"), F.when(F.col("id") % 2 == 0, value).alias("mem_ws"),
    ).write.parquet(path)
    stream = value_stream(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path), Tiering())
    run(start_buckets(stream, str(tmp_path / "values"), str(tmp_path / "cp"), None))
    assert spark.read.parquet(str(tmp_path / "values")).count() <= 3 * 1013
    row = read_ranked(spark, str(tmp_path / "values")).first()
    cpu = sorted((i * 7919) % 1013 for i in range(n))
    ws = sorted((i * 7919) % 1013 if i % 2 == 0 else 0 for i in range(n))  # missing usage is 0
    for prefix, values in (("cpu", cpu), ("ws", ws)):
        assert [row[f"{prefix}_{k}"] for k in ("p50", "p95", "p99", "max")] == [nearest_rank(values, q) for q in (0.5, 0.95, 0.99, 1)]
    assert row.n == n and row.usage_max == 2 * cpu[-1]


def test_missing_keys_and_usage_have_one_rule(spark, tmp_path):
    """A series without a container name, and missing usage, count alike in batch and exact silver."""
    bronze, silver = str(tmp_path / "bronze"), str(tmp_path / "silver")
    t = Tiering(as_of=T0 + timedelta(hours=1))
    rows = samples(spark, [(T0 + timedelta(seconds=i), v) for i, v in enumerate([1, 1, 1, 10, 20])]).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withColumns({"container_name": F.lit(None).cast("string"), "cpu_nano": F.when(F.col("cpu_nano") > 1, F.col("cpu_nano"))})
    write_samples(rows, bronze)
    run(start_silver(spark, bronze, silver, str(tmp_path / "cp"), t, None))
    kept = read_silver(spark, silver, t).collect()
    batch = buckets(rows, t).collect()
    assert [(r.container_name, r.n, r.cpu_p50, r.cpu_max) for r in kept] == [("", 5, 0.0, 20.0)]
    assert [(r.container_name, r.sample_count, r.cpu_p50, r.cpu_max) for r in batch] == [("", 5, 0.0, 20.0)]


def test_chained_hourly_stream(spark, tmp_path):
    rows = series_rows()
    path = str(tmp_path / "in")
    samples(spark, [*rows, (T0 + timedelta(days=30), 1)]).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    hourly = coarse_stream(fine_stream(stream, Tiering(), "1 hour"), Tiering())
    run(
        hourly.writeStream.format("memory").queryName("hourly").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    counted = spark.table("hourly").agg(F.sum("n")).first()[0]
    assert counted == len(rows)


def test_latest_metadata_as_stream_state(spark, tmp_path):
    from tests.helpers import METADATA

    path = str(tmp_path / "in")
    frame = samples(spark, [(T0, 1), (T0 + timedelta(minutes=1), 2)]).withColumns({c: F.lit(v) for c, v in METADATA.items()})
    frame.withColumn("cpu_request_millis", F.col("seq") + 10).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    run(
        latest_metadata(stream).writeStream.format("memory").queryName("meta").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    assert spark.table("meta").first().cpu_request_millis == 11


@pytest.mark.parametrize("mode", [EXACT, INCREMENTAL])
def test_silver_with_late_samples_equals_batch(spark, tmp_path, mode):
    bronze, silver = str(tmp_path / "bronze"), str(tmp_path / "silver")
    rows = series_rows(n=600, step=300)
    first, late = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    as_of = T0 + timedelta(days=2)
    t = Tiering(mode=mode, as_of=as_of)

    def stamped(part):
        return samples(spark, part).withColumn("ts", F.col("ts").cast("timestamp"))

    for part in (first, late):
        write_samples(stamped(part), bronze)
        run(start_silver(spark, bronze, silver, str(tmp_path / "cp"), t, None))
    got = summary_from_silver(read_silver(spark, silver, t), read_tail(spark, bronze, t), t)
    expected = series_summary(stamped(rows), t)
    columns = [c for c in expected.columns]
    assert [list(r) for r in got.select(columns).collect()] == [list(r) for r in expected.select(columns).collect()]
    assert series_summary(read_samples(spark, bronze, t), t).first() == expected.first()

    compact(spark, silver, str(tmp_path / "compact"), t)
    again = summary_from_silver(read_silver(spark, str(tmp_path / "compact"), t), read_tail(spark, bronze, t), t)
    assert again.first() == got.first()

    # retention: days before the first kept one go, others stay
    assert drop_days_before(spark, silver, "2026-03-01") == ["day=2026-02-28"]
    assert read_silver(spark, silver, t).filter(F.col("bucket_us") < F.unix_micros(F.lit("2026-03-01").cast("timestamp"))).count() == 0


def test_silver_clock_must_lie_on_a_bucket(spark):
    empty = samples(spark, [])
    with pytest.raises(ValueError):
        summary_from_silver(empty, empty, Tiering(as_of=datetime(2026, 3, 1, 0, 1)))
    with pytest.raises(ValueError):
        summary_from_silver(empty, empty, Tiering())


def test_periodic_reports(spark, tmp_path):
    (tmp_path / "usage").mkdir()
    land(tmp_path / "pods", "a.json", [pod_list("1")])
    bronze, out = str(tmp_path / "bronze"), str(tmp_path / "reports")
    rounds = (("0.json", T0 - timedelta(days=40), "gone"), ("a.json", T0, "web-abc-x"), ("b.json", T0 + timedelta(seconds=30), "web-abc-x"))
    for name, at, pod in rounds:
        land(tmp_path / "usage", name, [usage(at, 150_000_000, pod)])
        run(start_ingest(spark, str(tmp_path / "usage"), str(tmp_path / "pods"), bronze, str(tmp_path / "cp1"), None))
        run(start_reports(spark, bronze, out, str(tmp_path / "cp2"), Tiering(), None))
    reports = spark.read.parquet(out)
    assert reports.count() == 3
    newest = latest_per_node(reports.drop("batch_id")).collect()
    assert [(r.node_name, r.pod_count, r.total_cpu_waste_millis, r.seq) for r in newest] == [("n1", 2, 850.0, 2)]
    pods = spark.read.parquet(f"{out}-pods").filter("seq = 2").collect()
    assert {(r.pod_name, r.total_cpu_waste_millis) for r in pods} == {("gone", 0.0), ("web-abc-x", 850.0)}


def test_reports_cover_the_whole_retention(spark, tmp_path):
    """21 days of retention: a sample of 900m twelve days back still counts beside one of 100m now."""
    (tmp_path / "usage").mkdir()
    land(tmp_path / "pods", "a.json", [pod_list("1")])
    bronze, out = str(tmp_path / "bronze"), str(tmp_path / "reports")
    t = Tiering(coarse_keep_seconds=21 * 86_400)
    for name, at, nano in (("a.json", T0 - timedelta(days=12), 900_000_000), ("b.json", T0, 100_000_000)):
        land(tmp_path / "usage", name, [usage(at, nano, "web-abc-x")])
        run(start_ingest(spark, str(tmp_path / "usage"), str(tmp_path / "pods"), bronze, str(tmp_path / "cp1"), None))
        run(start_reports(spark, bronze, out, str(tmp_path / "cp2"), t, None))
    newest = latest_per_node(spark.read.parquet(out).drop("batch_id")).first()
    assert newest.total_cpu_waste_millis == 100.0


def test_ingest_without_specs(spark, tmp_path):
    land(tmp_path / "usage", "a.json", [usage(T0, 150_000_000, "web-abc-x")])
    bronze = str(tmp_path / "bronze")
    run(start_ingest(spark, str(tmp_path / "usage"), None, bronze, str(tmp_path / "cp"), None))
    assert [r.cpu_request_millis for r in spark.read.parquet(bronze).collect()] == [0]
