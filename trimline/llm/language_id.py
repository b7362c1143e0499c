"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word
is the sum over all its segmentations into pieces, which a forward pass over its characters adds up; a
text's score is the product over its words. Words are runs of letters, lower-cased, with the
vocabulary's word mark in front; a character that no piece covers has a small fixed probability.

The piece probabilities are fitted by expectation-maximisation on a bounded sample of labelled rows:
``sample_docs`` documents of each language, those with the smallest hashes of id and text, whole texts.
The counting of words and the expected piece counts run on Spark; the driver holds one number per
language and piece.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text when
there is nothing to learn from; ties between languages go to the name that sorts first; repeated rows
get equal answers; texts of any length are scored whole; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trimline.llm.batches import bound_batches, pieces
from trimline.scratch import written

MARK = "▁"
UNKNOWN = "und"
#: Documents of each language to learn from, and rounds of expectation-maximisation.
SAMPLE_DOCS, ROUNDS = 400, 3
#: Languages that one model may have; labels beyond that are an error, not a language list.
MOST_LANGUAGES = 500
#: Letters of a run that fitting takes as one word (longer runs count in parts; scoring takes all whole).
FITTED_LENGTH = 48
#: Added to every expected count, and the probability of a character outside the vocabulary.
SMOOTHING, OUTSIDE = 0.01, 1e-9
#: Words whose scores a Python worker remembers, before it starts afresh.
REMEMBERED = 120_000
#: Words that one forward pass takes.
PASS_WORDS = 20_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters with the word mark; numeric signs that count as word characters go."""
    found = (w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in _WORD.findall(text.lower()))
    return [MARK + w for w in found if w]


def load(path: str) -> list[str]:
    """Letter pieces of a sentencepiece file, lower-cased, on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    letters = (p for p in found if _WORD.fullmatch(p.removeprefix(MARK)))
    return list(dict.fromkeys(letters))


class Lattice:
    """Finds the pieces that end at every character of many words."""

    def __init__(self, vocabulary: list[str]):
        by_length: dict[int, list[int]] = {}
        for i, piece in enumerate(vocabulary):
            by_length.setdefault(len(piece), []).append(i)
        self.tables, self.power = {}, {}
        self.longest = max(by_length, default=0)
        for n, ids in sorted(by_length.items()):
            codes = np.frombuffer("".join(vocabulary[i] for i in ids).encode("utf-32-le"), np.uint32)
            keys = self._keys(codes.reshape(-1, n))[:, -1]
            order = np.argsort(keys)
            if (np.diff(keys[order]) == 0).any():
                raise ValueError("two pieces share a key")
            self.tables[n] = (keys[order], np.array(ids)[order])
            power = np.ones(1, np.uint64)
            for _ in range(n):
                power = power * _BASE
            self.power[n] = power[0]

    @staticmethod
    def _keys(codes: np.ndarray) -> np.ndarray:
        """Keys of all prefixes."""
        out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        for i in range(codes.shape[1]):
            out[:, i + 1] = out[:, i] * _BASE + codes[:, i].astype(np.uint64) + np.uint64(1)
        return out

    def arcs(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(end, length, words, pieces) of all pieces found in words of one length."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
        keys = self._keys(codes)
        for end in range(1, codes.shape[1] + 1):
            for n, (known, ids) in self.tables.items():
                if n > end:
                    break
                key = keys[:, end] - keys[:, end - n] * self.power[n]
                place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                found = np.flatnonzero(known[place] == key)
                if len(found):
                    yield end, n, found, ids[place[found]]


def _by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Indices of words of one length, in passes of bounded size."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(group):
            size = max(1, PASS_WORDS * 16 // max(16, int(lengths[group[0]])))
            for i in range(0, len(group), size):
                yield group[i : i + size]


def forward(lattice: Lattice, words: list[str], probability: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language: ``probability`` is pieces x languages."""
    out = np.zeros((len(words), probability.shape[1]))
    for group in _by_length(words):
        here = [words[i] for i in group]
        length = len(here[0])
        # the sums that a piece can still reach, scaled to 1 at their newest; the scale is kept as a logarithm
        alpha = np.zeros((length + 1, len(here), probability.shape[1]))
        alpha[0] = 1.0
        scale = np.zeros((len(here), probability.shape[1]))
        arcs = lattice.arcs(here)
        pending = next(arcs, None)
        for end in range(1, length + 1):
            alpha[end] = alpha[end - 1] * OUTSIDE
            while pending is not None and pending[0] == end:
                _, n, at, ids = pending
                alpha[end, at] += alpha[end - n, at] * probability[ids]
                pending = next(arcs, None)
            top = alpha[end].copy()
            scale += np.log(top)
            low = max(0, end - lattice.longest)
            alpha[low : end + 1] /= top
        out[group] = scale
    return out


def expected(lattice: Lattice, words: list[str], weights: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Expected count of each piece over all segmentations of the weighted words of one language."""
    counts = np.zeros(len(probability))
    for group in _by_length(words):
        here = [words[i] for i in group]
        length = len(here[0])
        arcs = list(lattice.arcs(here))
        alpha, beta = np.zeros((length + 1, len(here))), np.zeros((length + 1, len(here)))
        alpha[0], beta[length] = 1.0, 1.0
        by_end: dict[int, list] = {}
        for arc in arcs:
            by_end.setdefault(arc[0], []).append(arc)
        for end in range(1, length + 1):
            alpha[end] = alpha[end - 1] * OUTSIDE
            for _, n, at, ids in by_end.get(end, []):
                alpha[end, at] += alpha[end - n, at] * probability[ids]
        for end in range(length, 0, -1):
            beta[end - 1] += beta[end] * OUTSIDE
            for _, n, at, ids in by_end.get(end, []):
                beta[end - n, at] += beta[end, at] * probability[ids]
        share = weights[group] / alpha[length]
        for end, n, at, ids in arcs:
            np.add.at(counts, ids, alpha[end - n, at] * probability[ids] * beta[end, at] * share[at])
    return counts


@dataclass(frozen=True)
class Model:
    """Piece probabilities of each language."""

    vocabulary: list[str]
    languages: list[str]
    probability: np.ndarray  # pieces x languages


def fit(
    labelled: DataFrame,
    vocabulary: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS,
    rounds: int = ROUNDS,
) -> Model:
    """Fit on rows that have a text and a language."""
    spark = labelled.sparkSession
    rows = labelled.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")
    ).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in {lang_col}")
    if not sizes:
        return Model(vocabulary, [], np.zeros((len(vocabulary), 0)))
    # a threshold on the hash for each language first: about twice the sample reaches the window
    bounds = {r["lang"]: int(-(2**63) + min(1.0, 2.0 * sample_docs / r["count"]) * (2**64 - 1025)) for r in sizes}
    bound = F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])
    near = rows.withColumn("h", F.xxhash64("id", "text")).filter(F.col("h") <= bound[F.col("lang")])
    order = Window.partitionBy("lang").orderBy("h", "id")
    sample = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample_docs)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch["lang"], batch["text"]):
                for word in words_of(text):
                    # longer runs of letters count as consecutive parts
                    for at in range(0, len(word), FITTED_LENGTH):
                        part = word[at : at + FITTED_LENGTH]
                        found[lang, part] = found.get((lang, part), 0) + 1
            yield pd.DataFrame([(a, b, n) for (a, b), n in found.items()], columns=["lang", "word", "n"])

    counted = bound_batches(sample).select("lang", "text").mapInPandas(split, "lang string, word string, n long")
    counts = written(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # at most MOST_LANGUAGES
    probability = np.full((len(vocabulary), len(languages)), 1.0 / max(1, len(vocabulary)))
    shared_pieces = spark.sparkContext.broadcast(vocabulary)
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast((languages, probability))

        def expect(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            lattice, (languages, probability) = Lattice(shared_pieces.value), shared.value
            sums = np.zeros(probability.shape)
            for batch in batches:
                for lang, group in batch.groupby("lang"):
                    k = languages.index(lang)
                    sums[:, k] += expected(
                        lattice, group["word"].tolist(), group["n"].to_numpy(float), probability[:, k]
                    )
            at, k = np.nonzero(sums)
            yield pd.DataFrame({"piece": at, "k": k, "n": sums[at, k]})

        sums = counts.mapInPandas(expect, "piece long, k long, n double").groupBy("piece", "k").agg(F.sum("n").alias("n"))
        probability = np.full(probability.shape, SMOOTHING)
        for r in sums.collect():  # at most pieces x languages
            probability[r["piece"], r["k"]] += r["n"]
        probability /= probability.sum(axis=0)
    return Model(vocabulary, languages, probability)


class Scorer:
    """Scores texts; remembers a bounded number of words."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.vocabulary)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and its posterior probability under equal priors."""
        languages = self.model.languages
        if not languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        words = [words_of(t) for t in texts]
        flat = [w for text in words for w in text]
        new = list({w for w in flat if w not in self.known})
        if len(self.known) + len(new) > REMEMBERED:
            self._forget()
            new = list(set(flat))
        if new:
            new.sort()  # results must not depend on the order of a set
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.scores = np.concatenate([self.scores, forward(self.lattice, new, self.model.probability)])
        places = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        names, values, at = [], [], 0
        for text in words:
            if not text:
                names.append(UNKNOWN)
                values.append(0.0)
                continue
            total = self.scores[places[at : at + len(text)]].sum(axis=0)
            at += len(text)
            best = int(np.argmax(total))
            names.append(languages[best])
            values.append(float(1.0 / np.exp(total - total[best]).sum()))
        return names, values


def prediction(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The struct (lang_pred, score from 0 to 1) of a text column of ``docs``, from the text alone."""
    shared = bound_batches(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def languages(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            names: list[str] = []
            values: list[float] = []
            for _, texts in pieces(batch.tolist()):
                a, b = scorer.score(texts)
                names += a
                values += b
            yield pd.DataFrame({"lang_pred": names, "score": values})

    return languages.asNondeterministic()(F.col(f"`{text_col}`"))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``; columns of these names are replaced."""
    name = "__language"
    rows = docs.withColumn(name, prediction(docs, model, text_col))
    return rows.withColumns({c: F.col(f"{name}.{c}") for c in ("lang_pred", "score")}).drop(name)


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of documents that nothing is learnt from."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), F.lit(4)) == 2
