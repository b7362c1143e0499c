import math
import random

import pytest
from pyspark.sql import functions as F

from trimline.llm import oracle, queries, top_k
from verification import compare

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, rank string, row int"
LOW, HIGH = -(2**63), 2**63 - 1


def _brute(rows, k, every=5):
    ok = [(i, v) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(x * 256) if abs(x) < 2**52 else int(x) * 256 for x in v] for _, v in ok]
    out = []
    for q, (i, _) in enumerate(ok):
        if i % every:
            continue
        others = [c for c in range(len(ok)) if c != q and len(whole[c]) == len(whole[q])]
        scored = [(-min(max(sum(a * b for a, b in zip(whole[q], whole[c])), LOW), HIGH), ok[c][0]) for c in others]
        out += [(i, r, c, -s) for r, (s, c) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def _got(spark, rows, k=5, **options):
    docs = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    found = top_k.top_k(docs, F.col("vec_id") % 5 == 0, k, **options)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()))


def test_small_blocks_ties_and_invalid_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, [1.0, 1.0, 0.0, 0.0, 0.0, 0.5]) for i in range(90)]  # a third are copies
    rows += [(5, [0.25] * 6), (5, [0.25] * 6), (300, None), (305, [1.0, None, 1.0, 1.0]), (310, [math.nan] * 6)]
    rows += [(315, [math.inf] * 6), (320, []), (321, []), (325, [2.0]), (None, [1.0] * 6), (330, [-0.0001] * 6), (335, [0.0] * 6)]
    for options in ({}, {"candidate_values": 60, "query_values": 60, "spare": 0}):
        assert _got(spark, rows, **options) == _brute(rows, 5)


def test_large_products_are_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([1, -1]) * 2.0 ** rng.uniform(20, 31) for _ in range(4)]) for i in range(40)]
    rows += [(50, [1e308, 1e308, 0.0, 0.0]), (51, [1e308, -1e308, 0.0, 0.0]), (52, [1e-308, -1e-308, 5e-324, 0.0])]
    rows += [(60 + i, [2.0**50, float(i), 0.0, 0.0]) for i in range(3)]  # products that differ below a double's precision
    assert _got(spark, rows) == _brute(rows, 5)


@pytest.mark.parametrize("rows", [[], [(1, [1.0])], [(5, [1.0])], [(None, None)], [(5, [1.0]), (6, [-1.0])]])
def test_tiny_tables(spark, rows):
    assert _got(spark, rows) == _brute(rows, 5)


def test_query_equals_its_sql(spark):
    con = compare.connect(SF_DIR)
    columns, got = compare.spark_rows(queries.op11_top_k(spark, SF_DIR))
    names, expected = compare.oracle_rows(con, oracle.ORACLES["op11_top_k"])
    assert (columns, got) == (names, expected) and len(got) == 50
