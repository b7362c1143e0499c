import random

import pytest

from trimline.llm import queries, token_counts


@pytest.fixture(scope="module")
def model():
    return token_counts.load(queries.vocabulary_file("piece_bpe_32k.model"))


def _best(word, model):
    """(score, -tokens) of the best of all segmentations."""
    if not word:
        return 0.0, 0
    size = len(word[0].encode())
    rest = _best(word[1:], model)
    options = [(rest[0] + size * model.byte_score, rest[1] - size)]
    for n in range(1, len(word) + 1):
        if word[:n] in model.score:
            rest = _best(word[n:], model)
            options.append((rest[0] + model.score[word[:n]], rest[1] - 1))
    return max((round(a, 9), b) for a, b in options)


def test_trie_counts_equal_all_segmentations(model):
    rng = random.Random(3)
    words = list({"▁" + "".join(rng.choice("thean é漢😀xq") for _ in range(rng.randint(0, 7))) for _ in range(400)})
    trie = token_counts.Trie(model)
    assert [-_best(w, model)[1] for w in words] == trie.counts(words).tolist()
    long = ["▁" + "".join(rng.choice("theanéx") for _ in range(n)) for n in (63, 64, 65, 3000)]
    assert trie.counts(long).tolist() == [trie._single(w) for w in long]


def test_query_and_odd_rows(spark, model):
    sf_dir = "/root/testdata/sf0.001"
    trie = token_counts.Trie(model)
    docs = {r.doc_id: (r.text or "").split() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op9_token_counts(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        words = docs[r.doc_id]
        assert (r.n_pretokens, r.n_tokens) == (len(words), sum(trie._single("▁" + w) for w in words))
    rows = [(1, None, 9), (1, None, 9), (2, "", 9), (None, "the cat", 9), (3, "the " * 100_000, 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    counted = token_counts.count_tokens(frame, model).collect()
    assert sorted((r.doc_id or 0, r.n_pretokens, r.n_tokens) for r in counted) == [(0, 2, 1 + trie._single("▁cat")), (1, 0, 0), (1, 0, 0), (2, 0, 0), (3, 100_000, 100_000)]
    assert token_counts.count_tokens(frame.limit(0), model).count() == 0
