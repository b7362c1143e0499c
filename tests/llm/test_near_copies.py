import collections
import itertools
import random

import duckdb
import pytest

import corpus_pipeline
from trimline.llm import exact_dedup, near_copies, simhash


def _set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _near(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def _stay(texts, pairs):
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        if _near(texts[a], texts[b]):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {i for i in texts if top(i) == i}


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_stage_equals_brute_force_jaccard(spark, size):
    """Fails with fingerprints within two bits: they keep 5 and 47 near copies here."""
    docs = exact_dedup.without_copies(spark.read.parquet(f"/root/testdata/{size}/documents.parquet"))
    texts = {r.doc_id: _set(r.text) for r in docs.collect()}
    # every pair with a shingle in common and sizes that allow the similarity
    count = collections.Counter(g for s in texts.values() for g in s)
    by = collections.defaultdict(list)
    for i, s in texts.items():
        # similar sets share one of the rarest fifth, in any fixed order
        for g in sorted(s, key=lambda g: (count[g], g))[: len(s) // 5 + 1]:
            by[g].append(i)
    pairs = {p for ids in by.values() for p in itertools.combinations(sorted(ids), 2)}
    stay = _stay(texts, pairs)
    assert len(stay) < len(texts)
    got = [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").select("doc_id").collect()]
    assert sorted(got) == sorted(stay)


@pytest.mark.parametrize("rounds", [0, 1, 12])
def test_large_groups_are_joined_as_by_all_pairs(spark, rounds):
    """Copies of a text that lie near the threshold from each other, in buckets worked by pivots."""
    rng = random.Random(3)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(120)] for _ in range(2)]
    rows = []
    for i in range(160):
        text = list(words[i % 2])
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(text), "k"))
    rows += [(500, None, "k"), (501, " \t", "k"), (502, "One two", "k"), (503, "one  TWO", "k"), (None, "one two", "k"), (504, rows[3][1], "k"), (504, "z", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    texts = {i: _set(t) for i, t, _ in rows[:160]}
    stay = _stay(texts, itertools.combinations(texts, 2))
    left = near_copies.without_near_copies(docs, pairs=50, rounds=rounds)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([*stay, 500, 502, None], key=str)
    assert near_copies.without_near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [256, 16])
def test_a_group_that_no_pivot_joins_is_compared_in_blocks(spark, block, monkeypatch):
    """A chain: each text is near the next one only, so pivots join little."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(9)
    words, rows = [f"w{i}" for i in range(200)], []
    for i in range(90):
        for _ in range(2):
            words[rng.randrange(200)] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {i: _set(t) for i, t in rows}
    stay = _stay(texts, itertools.combinations(texts, 2))
    assert sorted(r.doc_id for r in near_copies.without_near_copies(docs, pairs=4).collect()) == sorted(stay)


def test_stage_takes_links_of_fingerprints_and_checks_them(spark, monkeypatch):
    """Without any band the stage still finds near copies within two bits; texts within two bits that are not near stay."""
    monkeypatch.setattr(near_copies, "bands", lambda similar=0.8: 0)
    words = [f"w{i}" for i in range(600)]
    again = " ".join(f"r{i}" for i in range(9)) + " "
    tails = [" ".join(f"{x}{i}" for i in range(40)) for x in "yz"]
    texts = {1: " ".join(words), 2: " ".join([*words[:-1], "x"]), 3: again * 300 + tails[0], 4: again * 300 + tails[1], 5: "alone " + tails[0][::-1]}
    prints = {i: simhash.fingerprint(t, words=5) for i, t in texts.items()}
    assert (prints[1] ^ prints[2]).bit_count() <= 2 and (prints[3] ^ prints[4]).bit_count() <= 2
    sets = {i: _set(t) for i, t in texts.items()}
    assert _near(sets[1], sets[2]) and not _near(sets[3], sets[4])
    docs = spark.createDataFrame([(i, t, "k") for i, t in texts.items()], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [1, 3, 4, 5]


def test_blocks_keep_their_documented_bound():
    assert near_copies.BLOCK == 256
