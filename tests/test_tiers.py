import random
from dataclasses import replace
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import T0, Replay, floor, nearest_rank, samples
from trimline.operators.buckets import buckets, in_order, merge_buckets, tier_counts
from trimline.operators.percentiles import metric_aggregate
from trimline.operators.series import series_keys, series_summary
from trimline.params import EXACT, INCREMENTAL, Tiering
from trimline.schemas import SERIES


def brute(rows, mode, clock=None):
    """Closed form over plain Python lists; ``clock`` None means the last sample."""
    clock = clock or max(t for t, _ in rows)
    kept = {}
    for at, v in rows:
        start = floor(at, 300)
        if at >= clock - timedelta(minutes=5):
            kept.setdefault(("live", clock - timedelta(minutes=5)), []).append(v)
        elif start >= clock - timedelta(hours=24):
            kept.setdefault(("fine", start), []).append(v)
        elif floor(start, 3600) >= clock - timedelta(days=7):
            kept.setdefault(("coarse", start), []).append(v)
    exact = [mode == EXACT or tier == "live" for tier, _ in kept]
    groups = list(kept.values())
    n = sum(map(len, groups))

    def q(p):
        return max(nearest_rank(g, p) if e else max(g) for g, e in zip(groups, exact))

    p50 = sum(nearest_rank(g, 0.5) * len(g) if e else sum(g) for g, e in zip(groups, exact)) / n
    return dict(n=n, p50=p50, p95=q(0.95), p99=q(0.99), max=max(map(max, groups)))


def series(kind, seed=1):
    rng = random.Random(seed)
    at, rows = T0, []
    for i in range(3000):
        step = {"regular": 300, "jittered": 290 + rng.randrange(20), "gapped": 300, "dense": 40}[kind]
        at += timedelta(seconds=step)
        if kind == "gapped" and i % 500 == 499:
            at += timedelta(hours=rng.randrange(1, 60))
        rows.append((at, rng.randrange(1, 10**9)))
    return rows


def got(summary):
    r = summary.first()
    return dict(n=r.sample_count, p50=r.cpu_p50, p95=r.cpu_p95, p99=r.cpu_p99, max=r.cpu_max)


@pytest.mark.parametrize("kind", ["regular", "jittered", "gapped", "dense"])
@pytest.mark.parametrize("mode", [EXACT, INCREMENTAL])
@pytest.mark.parametrize("hot_rows, hot_bucket_rows", [(10**6, 10**6), (10, 10**6), (10, 3)])
def test_summary_matches_closed_form(spark, kind, mode, hot_rows, hot_bucket_rows):
    rows = series(kind)
    shuffled = random.Random(2).sample(rows, len(rows))
    t = Tiering(mode=mode, hot_rows=hot_rows, hot_bucket_rows=hot_bucket_rows)
    assert got(series_summary(samples(spark, shuffled), t)) == pytest.approx(brute(rows, mode), rel=1e-12)


@pytest.mark.parametrize("mode", [EXACT, INCREMENTAL])
@pytest.mark.parametrize("hot_rows", [1_000_000, 10])
def test_fixed_clock(spark, mode, hot_rows):
    rows = series("dense")
    clock = T0 + timedelta(hours=20, minutes=2)
    t = Tiering(mode=mode, as_of=clock, hot_rows=hot_rows, hot_bucket_rows=5)
    seen = [r for r in rows if r[0] <= clock]
    assert got(series_summary(samples(spark, rows), t)) == pytest.approx(brute(seen, mode, clock), rel=1e-12)


@pytest.mark.parametrize("kind", ["regular", "gapped"])
def test_incremental_mode_equals_replay(spark, kind):
    rows, model = series(kind), Replay()
    for at, v in rows:
        model.record(at, v)
    summary = series_summary(samples(spark, rows), Tiering(mode=INCREMENTAL))
    assert got(summary) == pytest.approx(model.summary(), rel=1e-9)
    window = summary.first().data_window_ns
    assert window == model.window() // timedelta(microseconds=1) * 1000
    tiers = {r.tier: r.n for r in buckets(samples(spark, rows), Tiering(mode=INCREMENTAL)).groupBy("tier").agg(F.count("*").alias("n")).collect()}
    expected = {"fine": len(model.fine), "coarse": len(model.coarse), "live": 1}
    assert tiers == {k: v for k, v in expected.items() if v}


def test_jittered_replay_differs_only_in_p50(spark):
    rng, model, at, rows = random.Random(5), Replay(), T0, []
    for _ in range(2000):
        at += timedelta(seconds=27 + rng.randrange(7))
        rows.append((at, rng.randrange(1, 1000)))
        model.record(*rows[-1])
    result, replayed = got(series_summary(samples(spark, rows), Tiering(mode=INCREMENTAL))), model.summary()
    assert {k: result[k] for k in ("n", "p95", "p99", "max")} == {k: replayed[k] for k in ("n", "p95", "p99", "max")}


def test_boundaries_stay_in_the_younger_tier(spark):
    ages = {
        timedelta(0): "live", timedelta(minutes=5): "live", timedelta(minutes=5, microseconds=1): "fine",
        timedelta(minutes=10): "fine", timedelta(hours=24): "fine", timedelta(hours=24, microseconds=1): "coarse",
        timedelta(hours=25): "coarse", timedelta(days=7): "coarse", timedelta(days=7, microseconds=1): None, timedelta(days=8): None,
    }
    for age, tier in ages.items():
        rows = [(T0, 1), (T0 - age, 2)]
        found = {r.tier: r.n for r in tier_counts(samples(spark, rows), Tiering()).collect()}
        expected = {"live": 1}
        if tier:
            expected[tier] = expected.get(tier, 0) + 1
        assert found == expected, age


def test_buckets_in_order(spark):
    listed = in_order(buckets(samples(spark, series("regular")), Tiering())).collect()
    tiers = [r.tier for r in listed]
    assert tiers == sorted(tiers, key=["coarse", "fine", "live"].index) and set(tiers) == {"coarse", "fine", "live"}
    for tier in ("coarse", "fine"):
        starts = [r.bucket_start for r in listed if r.tier == tier]
        assert starts == sorted(starts)


def test_single_sample_and_single_fine_bucket_windows(spark):
    assert series_summary(samples(spark, [(T0, 1)]), Tiering()).first().data_window_ns == 0
    two = samples(spark, [(T0, 1), (T0 - timedelta(minutes=10), 2)])
    assert series_summary(two, Tiering()).first().data_window_ns == 600 * 10**9


def test_dead_series_keep_their_last_state_and_nodes_are_separate(spark):
    old = samples(spark, [(T0 - timedelta(days=90), 5)], pod="old")
    other = samples(spark, [(T0, 9)], pod="old", node="n2")
    both = old.unionByName(other)
    assert {(r.node_name, r.cpu_max) for r in series_summary(both, Tiering()).collect()} == {("n1", 5.0), ("n2", 9.0)}
    assert [r.node_name for r in series_summary(both, Tiering(as_of=T0)).collect()] == ["n2"]
    assert series_keys(both).count() == 2


def test_merge_rule(spark):
    ddl = "k int, n int, cpu_p50 double, cpu_p95 double, cpu_p99 double, cpu_max double"
    rows = [(1, 10, 100.0, 200.0, 300.0, 400.0), (1, 10, 200.0, 400.0, 500.0, 600.0),
            (2, 5, 100.0, 200.0, 300.0, 400.0), (2, 5, 200.0, 300.0, 400.0, 500.0), (2, 10, 300.0, 250.0, 350.0, 450.0),
            (3, 0, 7.0, 0.0, 0.0, 0.0), (4, 10, 100.0, 200.0, 300.0, 400.0)]
    merged = {r.k: r for r in merge_buckets(spark.createDataFrame(rows, ddl), ["k"], ("cpu",)).collect()}
    assert (merged[1].n, merged[1].cpu_p50, merged[1].cpu_p95, merged[1].cpu_p99, merged[1].cpu_max) == (20, 150.0, 400.0, 500.0, 600.0)
    assert (merged[2].n, merged[2].cpu_p50, merged[2].cpu_max) == (20, 225.0, 500.0)
    assert merged[3].cpu_p50 == 0.0
    assert (merged[4].cpu_p50, merged[4].cpu_max) == (100.0, 400.0)


@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_nearest_rank(spark, hot_rows):
    groups = {1: [42.0], 2: [10.0, 20.0], 3: [float(i) for i in range(1, 11)], 4: [float(i) for i in range(1, 101)],
              5: [-3.5, -3.5, 0.0, 1e-9, 2.0**60, 2.0**60], 6: [7.0] * 50}
    rng = random.Random(3)
    groups[7] = [rng.expovariate(1e-6) for _ in range(997)]
    groups[8] = [float(rng.randrange(10)) for _ in range(1000)]
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [(None, 1.0), (None, 2.0)], "k int, v double")
    result = {r.k: r for r in metric_aggregate(df, ["k"], {"v": "m"}, hot_rows).collect()}
    groups[None] = [1.0, 2.0]
    for k, vs in groups.items():
        r = result[k]
        assert (r.n, r.m_p50, r.m_p95, r.m_p99, r.m_max) == (
            len(vs), nearest_rank(vs, 0.5), nearest_rank(vs, 0.95), nearest_rank(vs, 0.99), max(vs)
        ), k


def test_rows_of_hot_groups_stay_where_they_are_read(spark):
    """Without a hint all rows are planned to be moved to the three partitions of their keys and sorted there."""
    df = spark.createDataFrame([(i % 3, float(i % 700)) for i in range(6000)], "k int, v double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        found = metric_aggregate(df, ["k"], {"v": "m"}, 500)
        rows = {r.k: r for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for k in range(3):
        vs = [float(i % 700) for i in range(6000) if i % 3 == k]
        assert (rows[k].n, rows[k].m_p50, rows[k].m_p99) == (2000, nearest_rank(vs, 0.5), nearest_rank(vs, 0.99))
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "LeftAnti" in line or "LeftSemi" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins), plan


def test_percentiles_of_nothing_are_zero(spark):
    df = spark.createDataFrame([(1, None)], "k int, v double")
    for hot_rows in (10, 1):
        r = metric_aggregate(df, ["k"], {"v": "m"}, hot_rows).first()
        assert (r.m_p50, r.m_p95, r.m_p99, r.m_max) == (0.0, 0.0, 0.0, 0.0)


def test_many_series_hot_and_ordinary_together(spark):
    frames = [samples(spark, series("dense", seed)[: 50 + 400 * (seed % 3)], pod=f"p{seed}") for seed in range(6)]
    frame = frames[0]
    for f in frames[1:]:
        frame = frame.unionByName(f)
    for mode in (EXACT, INCREMENTAL):
        ordinary = series_summary(frame, Tiering(mode=mode)).orderBy(*SERIES).collect()
        mixed = series_summary(frame, Tiering(mode=mode, hot_rows=400, hot_bucket_rows=6)).orderBy(*SERIES).collect()
        assert ordinary == mixed and len(ordinary) == 6


def test_parameters_are_checked():
    for bad in (dict(mode="x"), dict(fine_seconds=7), dict(coarse_seconds=7200 * 7), dict(hot_rows=0)):
        with pytest.raises(ValueError):
            replace(Tiering(), **bad)


@pytest.mark.parametrize("hot_rows", [1, 1000])
def test_ranks_of_nan_infinity_and_null(spark, hot_rows):
    """NaN sorts last, nulls do not count for ranks; the split path agrees with the sorting one."""
    nan, inf = float("nan"), float("inf")
    groups = {
        "nan": [float(i) for i in range(1, 20)] + [nan, nan],
        "inf": [-inf, -1.0, -0.0, 0.0, 2.0, inf, inf],
        "null": [None, None, 3.0],
        "none": [None],
    }
    rows = [(k, v) for k, values in groups.items() for v in values]
    got = {r.k: r for r in metric_aggregate(spark.createDataFrame(rows, "k string, v double"), ["k"], {"v": "v"}, hot_rows).collect()}

    def shown(r):
        return [str(x + 0.0) for x in (r.v_p50, r.v_p95, r.v_p99, r.v_max)]

    assert shown(got["nan"]) == ["11.0", "nan", "nan", "nan"]
    assert shown(got["inf"]) == ["0.0", "inf", "inf", "inf"]
    assert shown(got["null"]) == ["3.0"] * 4 and got["null"].n == 3
    assert shown(got["none"]) == ["0.0"] * 4 and got["none"].n == 1
