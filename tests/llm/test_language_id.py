import math
import zlib

import numpy as np
import pytest

from trimline.llm import language_id, queries


def test_accuracy_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op7_language_id(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.95 * len(held) and len(held) > 150


def _sum(word, probability):
    """Probability over all segmentations, by recursion."""
    if not word:
        return 1.0
    total = language_id.OUTSIDE * _sum(word[1:], probability)
    return total + sum(p * _sum(word[len(w) :], probability) for w, p in probability.items() if word.startswith(w))


VOCABULARY = ["a", "b", "ab", "ba", "aba", "▁a", "▁", "é"]


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(2)
    probability = rng.random((len(VOCABULARY), 3))
    words = ["▁" + "".join(rng.choice(list("abéx"), n)) for n in (1, 2, 3, 5, 7, 7, 9) for _ in range(5)]
    got = language_id.forward(language_id.Lattice(VOCABULARY), words, probability)
    for w, row in zip(words, got):
        for k in range(3):
            assert row[k] == pytest.approx(math.log(_sum(w, dict(zip(VOCABULARY, probability[:, k])))))
    # a word of any length neither overflows nor underflows
    assert np.isfinite(language_id.forward(language_id.Lattice(VOCABULARY), ["▁" + "ab" * 3000], probability)).all()


def test_expected_counts_are_derivatives():
    """The expected count of a piece is its probability times the derivative of the log likelihood."""
    rng = np.random.default_rng(4)
    p, words, weights = rng.random(len(VOCABULARY)), ["▁abab", "▁ba", "▁éaba"], np.array([2.0, 1.0, 3.0])
    lattice = language_id.Lattice(VOCABULARY)
    got = language_id.expected(lattice, words, weights, p)
    for i in range(len(p)):
        up, down = p.copy(), p.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (weights @ (language_id.forward(lattice, words, up[:, None]) - language_id.forward(lattice, words, down[:, None])))[0] / 2e-6
        assert got[i] == pytest.approx(p[i] * slope, rel=1e-4, abs=1e-6)


def test_odd_rows(spark):
    pieces = language_id.load(queries.vocabulary_file("piece_bpe_32k.model"))
    rows = [(i, "the cat and the dog", "en", "u", 1.0) for i in range(20)] + [(i, "der hund und die katze", "de", "u", 1.0) for i in range(20, 40)]
    rows += [(None, "le chat", None, None, None), (41, None, "fr", None, None), (42, "12 ² ½ !", None, None, None), (43, "", None, None, None)]
    rows += [(44, "the dog " * 20_000, None, None, None), (44, "Und DIE katze", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    model = language_id.fit(docs, pieces)
    assert model.languages == ["de", "en"]
    got = [(r.doc_id, r.text, r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()]
    assert len(got) == len(rows)
    for i, text, lang, score in got:
        if i in (41, 42, 43):
            assert (lang, score) == ("und", 0.0)
        elif text and ("dog" in text or "und" in text.lower()):
            assert lang == ("en" if "dog" in text else "de") and score > 0.5
    nothing = language_id.fit(docs.filter("lang = 'xx'"), pieces)
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_pieces_of_any_length_count():
    long = "▁" + "ab" * 12
    vocabulary = [*VOCABULARY, long]
    probability = np.full((len(vocabulary), 1), 0.3)
    got = language_id.forward(language_id.Lattice(vocabulary), [long], probability)[0, 0]
    without = language_id.forward(language_id.Lattice(VOCABULARY), [long], probability[:-1])[0, 0]
    assert math.exp(got) == pytest.approx(math.exp(without) + 0.3)
