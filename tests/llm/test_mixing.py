import math
import random
from collections import Counter
from fractions import Fraction

import pytest

from trimline.llm import mixing, queries

WEIGHTS = {"a": 0.5, "b": 0.3, "c": 0.19, None: 0.01}


@pytest.mark.parametrize("cycle", [10, 97, 1000])
def test_schedule_deviates_by_less_than_one_block(cycle):
    share = mixing.shares(WEIGHTS, cycle)
    total = sum(share.values())
    assert total == cycle and all(share.values())
    plan = mixing.schedule(share)
    assert sorted((s or "", b) for s, b, _ in plan) == sorted((s or "", b) for s, n in share.items() for b in range(n))
    run = dict.fromkeys(share, 0)
    for slot, (source, block, at) in enumerate(plan):
        n = share[source]
        assert at == slot and block == run[source]
        assert block * total // n <= slot < -(-(block + 1) * total // n)
        run[source] += 1
        assert all(abs(run[s] - share[s] * (slot + 1) / total) < 1 for s in share)


def test_all_rows_get_their_place(spark):
    rows = [(i, "a" if i % 3 else ("b" if i % 2 else None), "t", i, 7, 8) for i in range(1000)] + [(5, "a", "t", 0, 1, 2)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, slot long, block int, place int")
    weights = {"a": 1.0, "b": 1.0, None: 2.0, "absent": 1.0}
    got = mixing.mix(docs, weights, block_rows=4, cycle=10).collect()
    assert len(got) == len(rows)
    share = mixing.shares(weights, 10)
    of = {}
    for r in got:
        of.setdefault(r.source, []).append((r.block, r.place, r.slot))
    plan = {(s, b): t for s, b, t in mixing.schedule(share)}
    for source, places in of.items():
        places.sort()
        assert [(b, p) for b, p, _ in places] == [(i // 4, i % 4) for i in range(len(places))]
        for block, _, slot in places:
            assert slot == block // share[source] * 10 + plan[source, block % share[source]]
    # while all present sources have blocks, the mix follows the weights
    slots = sorted({(r.slot, r.source) for r in got}, key=lambda x: x[0])
    shortest = min(max(b for b, _, _ in p) // share[s] for s, p in of.items())
    early = [s for t, s in slots if t < shortest * 10]
    assert all(early.count(s) == shortest * share[s] for s in of)


def test_in_order_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], i) for i in range(200)], "doc_id long, source string, n_chars long")
    ordered = mixing.in_order(docs, {"a": 3.0, "b": 1.0}, block_rows=5, cycle=4)
    rows = ordered.collect()
    assert ordered.columns == docs.columns and len({r.doc_id for r in rows}) == 200
    assert [r.source for r in rows[:20]].count("a") == 15


def test_errors_and_empty(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "z")], "doc_id long, source string")
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 1.0})
    with pytest.raises(ValueError):
        mixing.shares({"a": 0.0})
    empty = docs.limit(0)
    assert mixing.mix(empty, mixing.tempered(empty)).count() == 0


def test_query_places_every_document(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = queries.op4_mixing(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert len({(r.slot, r.place) for r in got}) == len(got)


@pytest.mark.parametrize("sources", [2, 100, 5000])
def test_all_blocks_keep_to_the_real_weights(sources):
    """Fails with whole shares of 1,000 slots: they are off by more than a block, or ignore the weights."""
    rng = random.Random(sources)
    weights = {f"s{i}": rng.random() ** 3 + 1e-4 for i in range(sources - 1)} | {None: 0.5 * sources}
    total = sum(map(Fraction, weights.values()))
    slots = 20_000
    # as many blocks as the slots can take, so that no source runs out
    blocks = {s: int(Fraction(w) / total * slots) + 2 for s, w in weights.items()}
    run = dict.fromkeys(weights, 0)
    for at, (source, block, slot) in enumerate(mixing.slots(mixing.whole(weights), blocks)):
        if at == slots:
            break
        w = Fraction(weights[source]) / total
        assert slot == at and block == run[source]
        # the same as a deviation below one block after every slot
        assert int(block / w) <= slot < -int(-(block + 1) / w // 1)
        run[source] += 1
        if at % 1999 == 0 or (sources < 50 and at < 3000):
            assert all(abs(n - Fraction(weights[s]) / total * (at + 1)) < 1 for s, n in run.items())


def test_mix_follows_small_weights_to_the_end(spark):
    docs = spark.range(9000).selectExpr("id AS doc_id", "IF(id % 9 = 0, 'small', 'large') AS source")
    weights = {"small": 0.0005, "large": 0.9995}
    got = mixing.mix(docs, weights, block_rows=1).select("source", "block", "slot").collect()
    assert len(got) == 9000 and len({r.slot for r in got}) == 9000
    for r in got:
        w = Fraction(weights[r.source]) / sum(map(Fraction, weights.values()))
        assert r.block // w <= r.slot < -(-(r.block + 1) // w)


def _naive(weights, blocks):
    """(source, block) -> slot, by looking at all sources in every slot."""
    total = sum(Fraction(w) for w in weights.values())
    exact = {s: Fraction(w) / total for s, w in weights.items()}
    done, slot, out = dict.fromkeys(blocks, 0), 0, {}
    while any(done[s] < blocks[s] for s in blocks):
        free = [s for s in blocks if done[s] < blocks[s] and done[s] / exact[s] < slot + 1]
        if free:
            source = min(free, key=lambda s: (math.ceil((done[s] + 1) / exact[s]), s is not None, s or ""))
            out[source, done[source]] = slot
            done[source] += 1
        slot += 1
    return out


def test_query_equals_a_naive_schedule(spark):
    """Every row of the query against a schedule made slot by slot, and places that fill the blocks."""
    rows = queries.op4_mixing(spark, "/root/testdata/sf0.01").collect()
    counts = Counter(r.source for r in rows)
    weights = {s: float(n) ** mixing.TEMPERATURE for s, n in counts.items()}
    slots = _naive(weights, {s: -(-n // mixing.BLOCK_ROWS) for s, n in counts.items()})
    assert {(r.source, r.block): r.slot for r in rows} == slots
    for s, n in counts.items():
        places = sorted((r.block, r.place) for r in rows if r.source == s)
        assert places == [(i // mixing.BLOCK_ROWS, i % mixing.BLOCK_ROWS) for i in range(n)]


def test_columns_named_like_helpers_keep_their_values(spark):
    names = ["doc_id", "source", "__n", "__s", "__h", "__p", "__rank", "__low", "c0", "c1", "__id"]
    rows = [(i, "ab"[i % 2], *[f"{n}{i}" for n in names[2:]]) for i in range(6)]
    got = mixing.mix(spark.createDataFrame(rows, names), {"a": 0.5, "b": 0.5})
    assert got.columns == [*names, "block", "slot", "place"]
    assert sorted(tuple(r)[:-3] for r in got.collect()) == rows
