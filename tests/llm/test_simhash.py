import itertools
import random

import duckdb
import numpy as np
import pytest
import xxhash

from trimline.llm import queries, simhash
from trimline.llm.components import components


def _fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\x09\x0a\x0b\x0c\x0d":
        low = low.replace(space, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def _components(prints, distance=2):
    """Smallest id that every id reaches, by all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= distance:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    prints = {i: _fingerprint(t) for i, t in docs}
    groups = _components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in prints}


@pytest.mark.parametrize("distance", [1, 2])
@pytest.mark.parametrize("pair_bucket", [1, 64])
def test_links_of_crowded_fingerprints(spark, distance, pair_bucket):
    """Clusters around a few centres, far and near, through both kinds of buckets."""
    rng = random.Random(7)
    prints = {}
    for c in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            value = centre
            for _ in range(rng.randint(0, 4)):
                value ^= 1 << rng.randrange(64)
            prints.setdefault(value, len(prints))
    nodes = [(n, fp - (1 << 64) if fp >> 63 else fp) for fp, n in prints.items()]
    frame = spark.createDataFrame(nodes, "node long, fp long")
    got = {r.node: r.root for r in components(simhash.links(frame, distance, pair_bucket)).collect()}
    expected = _components({n: fp for fp, n in prints.items()}, distance)
    assert {i: got.get(i, i) for i in expected} == expected


def test_probes_keep_the_pigeonhole_promise():
    rng = np.random.default_rng(1)
    for rows in (1e3, 1e8, 1e12):
        sample = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) & ~np.uint64(0xFF)  # eight constant bits
        masks = simhash.probes(sample, rows)
        assert all(any(not (m >> a & 1 or m >> b & 1) for m in masks) for a, b in itertools.combinations(range(64), 2))
    assert len(simhash.probes(sample, 1e12)) > len(simhash.probes(sample, 1e3))  # more, narrower buckets


def test_allocation_is_the_cheapest():
    costs = [{-1: 0.0, 0: 5.0, 1: 9.0}, {-1: 0.0, 0: 1.0, 1: 2.0}, {-1: 0.0, 0: 4.0, 1: 50.0}]
    best = min(
        (sum(c[t] for c, t in zip(costs, ts)), list(ts)) for ts in itertools.product([-1, 0, 1], repeat=3) if sum(ts) == 0
    )
    assert simhash.allocate(costs, 0) == best


def test_nulls_empty_texts_and_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(3, None), (1, ""), (2, " \t"), (None, "x"), (4, "One two"), (5, "one  TWO"), (5, "one two"), (6, long), (7, long + " ")]
    docs = spark.createDataFrame([(*r, "k", 0) for r in rows], "doc_id long, text string, fp string, node int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    expected = [(i, f"{_fingerprint(t):016x}") for i, t in rows]
    assert sorted((a, b) for a, b, _ in got if a) == sorted(x for x in expected if x[0])
    assert {(a, c) for a, _, c in got} == {(3, 1), (1, 1), (2, 1), (None, None), (4, 4), (5, 4), (6, 6), (7, 6)}
    left = simhash.without_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == [1, 4, 6, None]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    hub = [(900, i) for i in range(200, 400)]
    frame = spark.createDataFrame([*chain, *hub, (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(frame).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 200 for i in [*range(200, 400), 900]}}
    assert components(frame.limit(0)).count() == 0
