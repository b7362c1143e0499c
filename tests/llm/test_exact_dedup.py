import hashlib
import re

import pytest

from trimline.llm import exact_dedup, oracle, queries
from verification import compare

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, digest string, keep_id string, __digest int"


def _norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


ROWS = (
    [(i, "hot  text\n", "x", None, 1) for i in range(20, 60)]
    + [(i, "hot text ", None, "y", 2) for i in range(60, 70)]
    + [(1, None, None, None, None), (2, "", None, None, None), (3, " ", None, None, None), (4, "\t\n", None, None, None)]
    + [(5, "a b", None, None, None), (5, "a b", None, None, None), (6, "a b", None, None, None)]
    + [(None, "a b", None, None, None), (None, "only nulls", None, None, None), (None, "only nulls", None, None, None)]
    + [(7, "x" * 100_000, None, None, None), (8, "x" * 100_000 + " ", None, None, None)]
)


@pytest.mark.parametrize("heavy", [1, 1000])
def test_decisions_equal_brute_force(spark, heavy):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    got = [tuple(r) for r in exact_dedup.decisions(docs, heavy=heavy).collect()]
    groups = {}
    for i, text, *_ in ROWS:
        groups.setdefault(_norm(text), []).append(i)
    expected = []
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = min(named) if named else None
        first = ids.index(keep)
        for k, i in enumerate(ids):
            expected.append((i, keep, len(ids), k == first, hashlib.sha256(text.encode()).hexdigest()))
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=order) == sorted(expected, key=order)


@pytest.mark.parametrize("heavy", [1, 1000])
def test_one_row_of_each_text_stays_with_all_columns(spark, heavy):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    left = exact_dedup.without_copies(docs, heavy=heavy)
    assert left.columns == docs.columns
    rows = left.collect()
    assert len(rows) == len({_norm(t) for _, t, *_ in ROWS})
    assert {r.doc_id for r in rows if _norm(r.text).strip() == "hot text"} == {20}
    assert {r.doc_id for r in rows if r.text == "a b"} == {5}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.decisions(docs).count() == 0
    assert exact_dedup.without_copies(docs).count() == 0


def test_query_equals_its_sql(spark):
    con = compare.connect(SF_DIR)
    columns, got = compare.spark_rows(queries.op10_exact_dedup(spark, SF_DIR))
    names, expected = compare.oracle_rows(con, oracle.ORACLES["op10_exact_dedup"])
    assert (columns, got) == (names, expected)


def test_plan_has_no_python(spark):
    plan = exact_dedup.decisions(spark.read.parquet(f"{SF_DIR}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_columns_named_like_helpers_keep_their_values(spark):
    names = ["doc_id", "text", "__digest", "__rank", "__keep_id", "digest_of_text", "id_to_keep", "place", "PLACE_"]
    rows = [(i, f"t{i % 2}", *[f"{n}{i}" for n in names[2:]]) for i in range(6)]
    left = exact_dedup.without_copies(spark.createDataFrame(rows, names))
    assert left.columns == names
    assert sorted(tuple(r) for r in left.collect()) == rows[:2]
