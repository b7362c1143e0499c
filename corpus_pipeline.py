"""Corpus preparation in five stages; each calls one operator of ``trimline.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the
columns of ``documents``; the last one returns tokens. Rows with nulls, empty texts, repeated rows and
further columns pass by the rules that the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trimline.llm import bpe, exact_dedup, language_id, mixing, simhash
from trimline.llm import near_copies as near
from trimline.llm.queries import vocabulary_file
from trimline.llm.tables import table
from trimline.scratch import written

#: Posterior probability of the best language below which a document is rejected.
LANGUAGE_SCORE = 0.5


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay; texts without a letter, and undecided ones, go.

    The model is fitted on the labelled documents themselves; the label is no input of the prediction.
    """
    model = language_id.fit(docs, language_id.load(vocabulary_file("piece_bpe_32k.model")))
    name = "__language"
    found = docs.withColumn(name, language_id.prediction(docs, model))
    known = F.col(f"{name}.lang_pred") != language_id.UNKNOWN
    return found.filter(known & (F.col(f"{name}.score") >= LANGUAGE_SCORE)).drop(name)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id stays."""
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard >= 0.8), the document with the smallest id stays.

    SimHash fingerprints of these shingles within two bits (general pigeonhole) name the first candidates; an exact check
    follows, and bands find the near copies whose fingerprints lie further apart.
    """
    linked = simhash.near_duplicates(docs, words=near.WORDS)
    return near.without_near_copies(docs, linked=linked)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, so that the files that are written are the mixture."""
    return mixing.in_order(docs, mixing.tempered(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, part and row (place in the mixture), n_tokens, ids, and digests of ids and decoded text."""
    vocabulary = bpe.load(vocabulary_file("byte_bpe_50k.json"))
    rows = docs.select(
        "doc_id",
        "text",
        F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("part"),
        F.col("_metadata.row_index").alias("row"),
    )
    # written in between, as two Python functions in one task are two workers, each with the vocabulary
    encoded = written(bpe.encode(rows, vocabulary).drop("text"), "encoded")
    return bpe.decode(encoded, vocabulary).select(
        "doc_id",
        "part",
        "row",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", languages),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("mixing", mixture),
    ("bpe", tokens),
]

#: Hashes of shingles, piece probabilities and BPE merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
