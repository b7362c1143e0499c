"""Every stage against plain Python on its own input."""

import hashlib
import itertools

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_exact_dedup import _norm
from tests.llm.test_near_copies import _set, _stay
from trimline.llm import queries
from trimline.scratch import written

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = [(10_001, None, None, None, None), (10_002, "", "en", "src0", 0), (10_003, "12 34 !", "en", None, 7), (None, "Is and of the to in that", None, None, None)]
    docs = written(docs.unionByName(spark.createDataFrame(odd, SCHEMA)), "docs")
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF_DIR), name)
        after = out.collect()
        ids = [r.doc_id for r in after]
        if name == "language_id":
            assert set(map(str, ids)) == {str(r.doc_id) for r in before} - {"10001", "10002", "10003"}
        elif name == "exact_dedup":
            first = {}
            for r in sorted(before, key=lambda r: (r.doc_id is None, r.doc_id)):
                first.setdefault(_norm(r.text), r.doc_id)
            assert sorted(ids, key=str) == sorted(first.values(), key=str)
        elif name == "simhash_near_dedup":
            # five-word shingles with a Jaccard similarity of 0.8, by brute force over all pairs
            sets = {r.doc_id: _set(r.text) for r in before if r.doc_id is not None}
            stay = _stay(sets, itertools.combinations(sets, 2))
            assert len(stay) < len(sets)
            assert sorted(ids, key=str) == sorted([*stay, None], key=str)
        elif name == "mixing":
            assert sorted(map(tuple, after), key=str) == sorted(map(tuple, before), key=str)
        else:
            library = Tokenizer.from_file(queries.vocabulary_file("byte_bpe_50k.json"))
            texts = {r.doc_id: r.text for r in before}
            assert len(after) == len(before) and len({(r.part, r.row) for r in after}) == len(after)
            for r in after:
                expected = library.encode(texts[r.doc_id], add_special_tokens=False).ids
                assert np.frombuffer(bytes(r.ids), "<u4").tolist() == expected and r.n_tokens == len(expected)
                assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        if name != "bpe":
            assert out.columns == docs.columns
        docs, before = out, after


def test_run_and_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, SF_DIR).count() > 100
