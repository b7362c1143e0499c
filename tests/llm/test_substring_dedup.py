import hashlib
import random

import duckdb
import numpy as np
import pytest

from trimline.llm import queries, substring_dedup


def _words(text):
    for space in "\x09\x0a\x0b\x0c\x0d":
        text = (text or "").replace(space, " ")
    return [w for w in text.split(" ") if w]


def _brute(docs, n=20):
    """Kept words and removed count by comparing every window with all earlier ones."""
    earliest, out = {}, []
    last = float("inf")
    for i, t in docs:
        words = _words(t)
        for s in range(len(words) - n + 1):
            place = (last if i is None else i, s)
            window = tuple(words[s : s + n])
            earliest[window] = min(earliest.get(window, place), place)
    for i, t in docs:
        words = _words(t)
        gone = set()
        for s in range(len(words) - n + 1):
            if earliest[tuple(words[s : s + n])] < (last if i is None else i, s):
                gone.update(range(s, s + n))
        out.append((i, " ".join(w for k, w in enumerate(words) if k not in gone), len(words), len(gone)))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    got = sorted((tuple(r) for r in queries.op3_substring_dedup(spark, sf_dir).collect()), key=str)
    expected = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, k in _brute(docs)]
    assert got == sorted(expected, key=str)
    assert sum(k > 0 for _, _, k, _ in got) > 10


def _made():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    docs = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if i % 3:
            a, b = sorted(rng.sample(range(71), 2))
            at = rng.randint(0, len(words))
            words[at:at] = passage[a:b]
        if i % 7 == 0:
            words += ["so"] * rng.randint(15, 60)
        docs.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    long = [rng.choice(vocabulary) for _ in range(60_000)]
    docs += [(100, " ".join(long)), (90, " ".join(long[500:900])), (None, " ".join(passage)), (None, None)]
    docs += [(101, None), (102, ""), (103, " \n"), (7, docs[7][1]), (104, " ".join(passage[:19])), (105, "  " + " ".join(passage[:20]))]
    return docs


@pytest.mark.parametrize("group_rows", [2_000, 4, 0])
def test_equals_brute_force_at_every_group_size(spark, group_rows):
    docs = _made()
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, d int, k string").repartition(5)
    got = substring_dedup.without_repeats(frame, group_rows=group_rows).collect()
    assert sorted((tuple(r) for r in got), key=str) == _brute(docs)


def test_other_lengths_and_empty_table(spark):
    docs = _made()[:60]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = substring_dedup.without_repeats(frame, min_words=11).collect()
    assert sorted((tuple(r) for r in got), key=str) == _brute(docs, 11)
    assert substring_dedup.without_repeats(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.without_repeats(frame, min_words=5)


def test_word_numbers_of_any_size_are_told_apart():
    """Numbers of 2**21 and more do not run into their neighbours."""
    words = np.zeros((4, 20), np.int64)
    words[0, 1], words[1, 0] = 1, 1 << 21
    words[2, 1], words[3, 0] = 1, 1 << 40
    order = np.array([[0, 0], [1, 0], [2, 0], [3, 0]])
    assert substring_dedup.repeated_windows(words, 20, order).tolist() == [False, False, True, False]
