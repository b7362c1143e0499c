import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from trimline.llm import bpe, queries

PATH = queries.vocabulary_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_character_classes_equal_the_library(library):
    table, cut = bpe.character_classes(), library.pre_tokenizer.pre_tokenize_str
    expected = {
        bpe.LETTER: [(0, 2), (2, 3), (3, 4)],
        bpe.NUMBER: [(0, 1), (1, 4)],
        bpe.OTHER: [(0, 1), (1, 2), (2, 3), (3, 4)],
    }
    for code in [*range(0x3500), *range(0xA000, 0xD800), *range(0xF900, 0x20000), 0x2F800, 0xE0001]:
        if code == 0x20:
            continue
        ch, kind = chr(code), table[code]
        if kind == bpe.SPACE:
            assert len(cut(f"!{ch}!")) == 3, hex(code)
        else:
            assert [s for _, s in cut(f"a{ch}1{ch}")] == expected[kind], hex(code)


def test_random_texts_equal_the_library(vocabulary, library):
    rng = random.Random(1)
    parts = ["'", "s", "re", " ", "  ", "\n", "\t", "a", "B", "1", "²", "!", "é", "中", "\u3000", "\xa0", "'ll", "====", "<|endoftext|>", "<|end", "\u0301", "😀", "\x85", "\x1c", "\0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    texts += ["a" * 5000, "=" * 3001, "ab" * 3000, " " * 100, "", "<|endoftext|><|endoftext|>"]
    encoder, decoder = bpe.Encoder(vocabulary), bpe.Decoder(vocabulary)
    expected = library.encode_batch(texts, add_special_tokens=False)
    for text, ids, e in zip(texts, encoder.encode(texts), expected):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, repr(text)
        assert decoder.decode(ids) == library.decode(e.ids, skip_special_tokens=False) == text


def test_broken_bytes_decode_like_the_library(vocabulary, library):
    rng, decoder = random.Random(2), bpe.Decoder(vocabulary)
    for _ in range(300):
        ids = [rng.randrange(256) for _ in range(8)]
        assert decoder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_query_equals_the_library(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op8_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for doc in docs:
        ids = library.encode(doc.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        row = got[doc.doc_id]
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == expected


def test_odd_rows(spark, vocabulary):
    long = "".join(random.Random(3).choice("ab c\n'é1") for _ in range(300_000))
    rows = [(1, None, 5), (1, None, 5), (2, "", 6), (None, "a b", 7), (4, long, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded int")
    got = bpe.digests(docs, vocabulary).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.n_tokens, r.ids_sha256 == empty, r.decoded_sha256 == empty) for r in got)[:3] == [(0, True, True)] * 3
    assert {r.decoded_sha256 for r in got if r.doc_id == 4} == {hashlib.sha256(long.encode()).hexdigest()}
    assert bpe.digests(docs.limit(0), vocabulary).count() == 0
