from trimline.streaming.snapshots import KEPT, Snapshots, newest


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, v long, day int")


def shown(frame):
    return sorted((r.k, r.v) for r in frame.collect())


def test_newest_takes_whole_groups_and_null_keys(spark):
    rows = spark.createDataFrame(
        [("a", 1, 5, "x"), ("a", 2, 1, "y"), ("a", 2, 3, "z"), ("a", 2, 3, "w"), (None, 1, 1, "n"), (None, 2, None, "m")],
        "k string, version long, seq long, v string",
    )
    assert {r.v for r in newest(rows, ["k"]).collect()} == {"y", "z", "w", "m"}
    assert {r.v for r in newest(rows, ["k"], ["version", "seq"]).collect()} == {"z", "w", "m"}
    plan = newest(rows, ["k"], ["version", "seq"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_versions_replays_and_compaction(spark, tmp_path):
    t = Snapshots(spark, str(tmp_path / "t"), ["day"])
    assert t.read() is None
    for version in range(9):
        t.merge(table(spark, [("a", version, 1), (f"b{version}", version, version % 2)]), version, ["k"], compact_every=3)
    expected = sorted([("a", 8), *((f"b{i}", i) for i in range(9))])
    assert shown(newest(t.read(), ["k"])) == expected and len(t.parts()) <= 3
    # a replayed batch starts from the version before it
    t.merge(table(spark, [("a", 8, 1), ("b8", 8, 0)]), 8, ["k"], compact_every=3)
    assert shown(newest(t.read(), ["k"])) == expected
    assert shown(newest(t.read(before=8), ["k"])) == sorted([("a", 7), *((f"b{i}", i) for i in range(8))])
    assert len(t._manifests()) == KEPT
    assert len(t._names("parts")) <= KEPT * 3


def test_a_reader_keeps_its_version_while_rows_are_evicted(spark, tmp_path):
    t = Snapshots(spark, str(tmp_path / "t"))
    t.append(table(spark, [("a", 1, 1), ("b", 2, 2)]), 0)
    before = t.read()
    t.replace(t.read().filter("day > 1"), 1)
    assert shown(before) == [("a", 1), ("b", 2)]
    assert shown(t.read()) == [("b", 2)]


def test_compaction_drops_rows_that_expired(spark, tmp_path):
    t = Snapshots(spark, str(tmp_path / "t"))
    for version in range(3):
        t.merge(table(spark, [(f"k{version}", version, version)]), version, ["k"], keep=lambda r: r.filter("day > 0"), compact_every=2)
    assert shown(t.read()) == [("k1", 1), ("k2", 2)]


def test_a_single_part_is_read_without_comparing_versions(spark, tmp_path):
    t = Snapshots(spark, str(tmp_path / "t"))
    assert t.newest(["k"]) is None
    t.append(table(spark, [("a", 1, 1), ("b", 2, 2)]), 0)
    first = t.newest(["k"], where=lambda rows: rows.filter("day > 1"))
    assert shown(first) == [("b", 2)]
    assert "Join" not in first._jdf.queryExecution().optimizedPlan().toString()
    t.append(table(spark, [("a", 5, 1)]), 1)
    assert shown(t.newest(["k"])) == [("a", 5), ("b", 2)]
    assert shown(t.newest(["k"], 1)) == [("a", 1), ("b", 2)]
