import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from trimline.llm import collocations, oracle, queries
from verification import compare

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, n long, p string, hash int"


def _brute(rows, least, top=2000, share=80):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        ranked = []
        for g, a in found.items():
            inside = [b for h, b in found.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
            if any(100 * b >= share * a for b in inside):
                continue
            score, k = min((2_000_000 * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
            ranked.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        for r, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, r, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def _rows():
    rng = random.Random(4)
    vocabulary = ["a", "B", "c", "Dé", "x y", "long" * 40, "\u0000", " z"]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(vocabulary[: rng.choice([3, 8])]) + rng.choice([" ", " ", "\t ", "  ", ", ", "\n", "\x0b", ". "]) for _ in range(rng.randint(0, 60)))
        rows.append((text, ["en", "de", None, "und"][i % 4]))
    rows += [("hot pair of words. " * 400, "en"), ("same same " * 300, "de"), (None, "en"), ("", None), (" \t\n", "xx"), ("É é", "de")]
    return rows


@pytest.mark.parametrize("bucket", [1 << 18, 40, 1])
def test_equals_brute_force(spark, bucket, monkeypatch):
    rows = _rows()
    docs = spark.createDataFrame([(i, t, g, 1, "p", 2) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(3)
    got = collocations.mine(docs, least=7, top=25, bucket=bucket)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == _brute(rows, 7, 25)


def test_text_is_cut_between_words_only(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 7)
    texts = [t for t, _ in _rows()[:60]] + ["word" * 50, None, "a b"]
    parts = list(collocations._chunks(texts))
    whole = b"\n".join((t or "").encode().translate(collocations._BYTES) for t in texts)
    assert [w for p in parts for w in collocations._words(p)][:-1] == collocations._words(whole)


def test_quicksort_counts_equal_partitions():
    rng = np.random.default_rng(1)
    words = rng.integers(1, 5, (4, 500)).astype(np.uint64)
    for d in range(1, 4):
        words[d][(rng.random(500) < 0.1) | (words[d - 1] == 0)] = 0
    weights = rng.integers(1, 4, 500)
    expected = Counter()
    for i in range(500):
        for d in range(1, 5):
            if words[d - 1, i]:
                expected[tuple(words[:d, i])] += int(weights[i])
    got = {tuple(words[:d, at]): n for d, at, n in collocations.equal_partitions(words, weights, 20)}
    assert got == {g: n for g, n in expected.items() if n >= 20}


def test_huge_counts_do_not_overflow(spark):
    a = 9 * 10**12
    row = spark.sql(f"select cast({a}L as decimal(20, 0)) * {collocations.SCORE} div ({a}L + {a}L) as s").first()
    assert row.s == 1_000_000


def test_empty_table(spark):
    assert collocations.mine(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_its_sql(spark):
    con = compare.connect(SF_DIR)
    columns, got = compare.spark_rows(queries.op12_collocations(spark, SF_DIR))
    names, expected = compare.oracle_rows(con, oracle.ORACLES["op12_collocations"])
    assert (columns, got) == (names, expected) and len(got) > 200
