"""The incrementally kept report against the batch operators over all samples."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import METADATA_DDL, SAMPLE_DDL, T0
from trimline.operators.series import latest_metadata, series_summary
from trimline.operators.waste import container_waste, node_waste, pod_waste
from trimline.params import EXACT, INCREMENTAL, Tiering
from trimline.schemas import SERIES
from trimline.sources.bronze import write_samples
from trimline.sources.reports import latest_per_node
from trimline.streaming import reports
from trimline.streaming.reports import ReportView, snapshots_of, start_reports
from trimline.streaming.snapshots import newest


def rows_of(rng, begin, hours, series, step):
    out = []
    for node, pod in series:
        at = begin
        while at < begin + timedelta(hours=hours):
            at += timedelta(seconds=rng.randint(1, 2 * step))
            cpu = rng.choice([None, rng.randint(1, 9) * 10**8])
            owner = rng.choice([("", ""), ("Deployment", "web"), ("StatefulSet", "db")])
            out.append((node, "ns", pod, "c", at, rng.randint(0, 3), cpu, 5, rng.randint(1, 10**9), rng.choice([0, 500, 1000]), 0, 10**9, 0, 1, "Burstable", *owner))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, f"{SAMPLE_DDL}, {METADATA_DDL}").withColumn("ts", F.col("ts").cast("timestamp"))


def shown(df):
    return sorted((tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def batches(seed):
    """Live series, one that stops, one that comes back, and samples that are late by hours and by days."""
    rng = random.Random(seed)
    live, stopped, back = [("n1", "a"), ("n2", "b")], [("n1", "gone")], [("n3", "back")]
    return [
        rows_of(rng, T0, 30, [*live, *stopped, *back], 900),
        rows_of(rng, T0 + timedelta(hours=30), 3, live, 200),
        rows_of(rng, T0 + timedelta(hours=33), 40, live, 1800) + rows_of(rng, T0 + timedelta(hours=20), 2, live, 600),
        rows_of(rng, T0 + timedelta(hours=73), 1, [*live, *back], 60) + rows_of(rng, T0 - timedelta(days=9), 2, live, 600),
        rows_of(rng, T0 + timedelta(hours=74), 1, live, 60),
    ]


@pytest.mark.parametrize("mode", [EXACT, INCREMENTAL])
def test_view_equals_batch_after_every_batch(spark, tmp_path, mode, monkeypatch):
    monkeypatch.setattr(reports, "COMPACT_BUCKETS", 3)
    t = Tiering(fine_keep_seconds=20 * 3600, coarse_keep_seconds=2 * 86_400, mode=mode)
    bronze = str(tmp_path / "bronze")
    view, so_far = ReportView(spark, bronze, str(tmp_path / "reports"), t), []
    for version, rows in enumerate(batches(3)):
        so_far += rows
        write_samples(frame(spark, rows), bronze)
        got = snapshots_of(view.update(frame(spark, rows), version))
        samples = frame(spark, so_far)
        expected = series_summary(samples, t).join(latest_metadata(samples), list(SERIES))
        columns = [c for c in expected.columns if c not in ("restart_count",)]
        # rows of one (ts, seq) may tie; metadata of ties is not compared
        ties = samples.groupBy(*SERIES, "ts", "seq").count().filter("count > 1")
        assert ties.limit(1).count() == 0
        assert shown(got.select(columns)) == shown(expected.select(columns))
    assert view.series.read().count() < 5 * 4 + 1 and newest(view.series.read(), SERIES).count() == 4
    # what left the retention of its series is gone from the kept tables
    old = view.buckets.read().filter("bucket_us < unix_micros(timestamp '2026-02-25')").count()
    assert old == 0


def test_reports_of_a_stream_equal_the_batch(spark, tmp_path):
    t = Tiering()
    bronze, out = str(tmp_path / "bronze"), str(tmp_path / "reports")
    parts = batches(4)
    for rows in parts:
        write_samples(frame(spark, rows), bronze)
        query = start_reports(spark, bronze, out, str(tmp_path / "cp"), t, None)
        query.awaitTermination(300)
        assert query.exception() is None
    samples = frame(spark, [r for rows in parts for r in rows])
    containers = container_waste(series_summary(samples, t).join(latest_metadata(samples), list(SERIES)))
    newest_reports = latest_per_node(spark.read.parquet(out).drop("batch_id")).drop("report_time", "seq")
    assert shown(newest_reports) == shown(node_waste(pod_waste(containers)))


def test_a_fixed_clock_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        start_reports(spark, str(tmp_path), str(tmp_path), str(tmp_path), Tiering(as_of=T0))
