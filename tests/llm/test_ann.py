import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trimline.llm import ann, queries


def _brute(ids, vectors, asked, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for q in asked:
        score = unit @ unit[ids.index(q)]
        order = sorted((-s, i) for s, i in zip(score, ids) if i != q)[:k]
        out[q] = [i for _, i in order]
    return out


def test_recall_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.1"
    frame = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    got = queries.op1_ann(spark, sf_dir).toPandas()
    ids, vectors = frame.vec_id.tolist(), np.stack(frame.embedding).astype(float)
    expected = _brute(ids, vectors, [i for i in ids if i % 50 == 0], 5)
    assert set(got.query_id) == set(expected)
    assert (got.groupby("query_id").size() == 5).all()
    found = sum(len(set(g.vec_id) & set(expected[q])) for q, g in got.groupby("query_id"))
    assert found >= 0.9 * 5 * len(expected)
    at = {i: n for n, i in enumerate(ids)}
    for r in got.itertuples():
        a, b = vectors[at[r.query_id]], vectors[at[r.vec_id]]
        assert r.score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)
    for _, g in got.groupby("query_id"):
        ordered = g.sort_values("rank")
        assert ordered["rank"].tolist() == [1, 2, 3, 4, 5]
        keys = list(zip(-ordered.score, ordered.vec_id))
        assert keys == sorted(keys)


def test_a_searched_part_of_the_table_finds_nine_of_ten(spark):
    """Leaves and chunks well below the table's size."""
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((3000, 16))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = ann.neighbours(rows, F.col("vec_id") % 50 == 0, leaf_rows=64, search_rows=1500, chunk_rows=20).toPandas()
    expected = _brute(list(range(3000)), vectors, range(0, 3000, 50), 5)
    found = sum(len(set(g.vec_id) & set(expected[q])) for q, g in got.groupby("query_id"))
    assert found >= 0.9 * 5 * len(expected)


def test_ties_copies_and_unusable_vectors(spark):
    same = [1.0, 2.0]
    rows = [(i, same) for i in range(0, 400)] + [
        (1000, [2.0, 1.0]),
        (1000, [2.0, 1.0]),
        (1050, None),
        (1100, [0.0, 0.0]),
        (1150, [1.0, None]),
        (1200, [float("nan"), 1.0]),
        (1250, [float("inf"), 1.0]),
        (1300, [1.0, 2.0, 3.0]),
        (None, same),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("q", F.lit(1)).withColumn("v", F.lit(2))
    got = ann.neighbours(frame, F.col("vec_id") % 50 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(by) == {*range(0, 400, 50), 1000}
    assert sorted(by[0]) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    assert sorted(by[50]) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert sorted(by[1000]) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]


def test_few_and_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.neighbours(frame, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1.0)]
    assert ann.neighbours(frame.limit(0), F.col("vec_id") == 0).collect() == []


def test_recall_with_production_parameters_beyond_100_000_vectors():
    """The forest and the budget of a run over 200,000 vectors; 40,000 rows find fewer than nine of ten."""
    rng = np.random.default_rng(9)
    unit = ann._unit(rng.standard_normal((200_000, 64)))
    depth = ann.levels(len(unit), ann.SAMPLE_ROWS)
    forest = ann.plant(unit[: ann.SAMPLE_ROWS], ann.TREES, depth)
    leaves = forest.leaves(unit)
    order = np.argsort(leaves, axis=0, kind="stable")
    sizes = np.stack([np.bincount(leaves[:, t], minlength=1 << depth) for t in range(ann.TREES)])
    ends = sizes.cumsum(axis=1)
    queries = np.arange(0, len(unit), len(unit) // 50)
    score = unit[queries] @ unit.T
    score[np.arange(len(queries)), queries] = -2
    best = np.argpartition(-score, 5, axis=1)[:, :5]

    def recall(wanted):
        found = 0
        for q, near in zip(queries, best):
            met = [order[ends[t, x] - sizes[t, x] : ends[t, x], t] for t, x in forest.search(unit[q], sizes, wanted)]
            found += np.isin(near, np.concatenate(met)).sum()
        return found / best.size

    now, before = recall(ann.budget(len(unit))), recall(40_000)
    print(f"recall@5 {now:.3f}, with 40,000 rows {before:.3f}")
    assert now >= 0.9 > before


def test_parallel_huge_and_tiny_vectors(spark):
    """Vectors of one direction and many lengths tie; squares beyond the range of a double do no harm."""
    rows = [(i, [float(i + 1) * x for x in (1.0, 3.0, 0.1)]) for i in range(800)]
    found = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 400 == 0)
    got = {q: [] for q in (0, 400)}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(r.vec_id)
        assert r.score == 1.0
    assert got == {0: [1, 2, 3, 4, 5], 400: [0, 1, 2, 3, 4]}

    rows = [(0, [1.0, 1.0]), (1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1e200, 0.0]), (4, [-1e-200, -3e-200]), (5, [1e308, -1e308])]
    found = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0)
    got = [(r.vec_id, r.score) for r in sorted(found.collect(), key=lambda r: r["rank"])]
    assert [i for i, _ in got] == [1, 2, 3, 5, 4]
    assert [s for _, s in got] == pytest.approx([1.0, 1.0, 0.5**0.5, 0.0, -4 / 20**0.5], abs=1e-15)
