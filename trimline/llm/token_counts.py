"""Token counts under a unigram model over a fixed public vocabulary, with a trie-shared forward pass.

A text is cut at white space; each pre-token gets the vocabulary's word mark in front. A pre-token's
segmentation is the one of the largest total log probability, and of those the one of fewest tokens.
Pieces have the probability of their rank under Zipf's law; a character that no piece covers falls
back to one token per UTF-8 byte.

The distinct pre-tokens of a piece of text are put in a trie, level by level. The forward score of a
node (best score of its prefix, and the tokens of that best segmentation) depends on its ancestors
only, so it is computed once for all pre-tokens that share the prefix. Terminal nodes keep the counts.

Defined results: a null text counts as empty, with 0 pre-tokens and 0 tokens; texts of any length count
whole; rows pass through one by one, also when they repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trimline.llm.batches import bound_batches, pieces

MARK = "▁"
#: Characters of a pre-token up to which levels are worked as arrays; longer ones go one by one.
LEVELS = 64
#: Pre-tokens whose counts a Python worker remembers, before it starts afresh.
REMEMBERED = 150_000

_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Unigrams:
    """Log probabilities of pieces, and of the byte that stands for what no piece covers."""

    score: dict[str, float]
    byte_score: float


def zipf(pieces_by_rank: list[str], byte_tokens: int = 256) -> Unigrams:
    """Pieces in the order of their rank; bytes share the rank after the last piece."""
    usable = [p for p in dict.fromkeys(pieces_by_rank) if p]
    weights = 1.0 / np.arange(1, len(usable) + byte_tokens + 1)
    logs = np.log(weights / weights.sum())
    return Unigrams(dict(zip(usable, logs[: len(usable)].tolist())), float(logs[-1]))


def load(path: str) -> Unigrams:
    """Pieces of a sentencepiece file on the driver, bytes and control pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
    return zipf([model.id_to_piece(i) for i in ranked])


def _byte_length(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)


class Trie:
    """Counts tokens of distinct pre-tokens."""

    def __init__(self, model: Unigrams):
        self.model = model
        lengths: dict[int, list[str]] = {}
        for piece in model.score:
            lengths.setdefault(len(piece), []).append(piece)
        self.tables = {}
        for n, words in sorted(lengths.items()):
            codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, n)
            keys = np.zeros(len(words), np.uint64)
            for column in codes.T:
                keys = keys * _BASE + column.astype(np.uint64) + np.uint64(1)
            order = np.argsort(keys)
            if (np.diff(keys[order]) == 0).any():
                raise ValueError("two pieces share a key")
            scores = np.array([model.score[w] for w in words])
            self.tables[n] = (keys[order], scores[order])
        self.power = {n: _power(n) for n in self.tables}
        self.longest = max(self.tables, default=0)

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each distinct word."""
        out = np.zeros(len(words), np.int64)
        short = [i for i, w in enumerate(words) if len(w) <= LEVELS]
        if short:
            out[short] = self._levels([words[i] for i in short])
        for i, word in enumerate(words):
            if len(word) > LEVELS:
                out[i] = self._single(word)
        return out

    def _levels(self, words: list[str]) -> np.ndarray:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        first = np.cumsum(lengths) - lengths
        # levels[d] has the nodes of depth d: parents, prefix keys, scores and token counts
        parents = [np.zeros(1, np.int64)]
        keys, score, tokens = [np.zeros(1, np.uint64)], [np.zeros(1)], [np.zeros(1, np.int64)]
        node = np.zeros(len(words), np.int64)  # of each word, at the current depth
        result = np.zeros(len(words), np.int64)
        active = np.arange(len(words))
        depth = 0
        while True:
            ends = lengths[active] == depth
            result[active[ends]] = tokens[depth][node[active[ends]]]
            active = active[~ends]
            if not len(active):
                return result
            codes = flat[first[active] + depth].astype(np.int64)
            joint = (node[active] << 21) | codes
            distinct, node[active] = np.unique(joint, return_inverse=True)
            depth += 1
            parent, code = distinct >> 21, distinct & 0x1FFFFF
            parents.append(parent)
            keys.append(keys[depth - 1][parent] * _BASE + code.astype(np.uint64) + np.uint64(1))
            size = _byte_length(code)
            best = score[depth - 1][parent] + size * self.model.byte_score
            count = tokens[depth - 1][parent] + size
            ancestor = np.arange(len(distinct))
            for n in range(1, min(depth, self.longest) + 1):
                ancestor = parents[depth - n + 1][ancestor]
                if n not in self.tables:
                    continue
                known, scores = self.tables[n]
                key = keys[depth] - keys[depth - n][ancestor] * self.power[n]
                place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                found = np.flatnonzero(known[place] == key)
                at = ancestor[found]
                s, c = score[depth - n][at] + scores[place[found]], tokens[depth - n][at] + 1
                better = (s > best[found]) | ((s == best[found]) & (c < count[found]))
                best[found[better]], count[found[better]] = s[better], c[better]
            score.append(best)
            tokens.append(count)

    def _single(self, word: str) -> int:
        """The same recurrence along one long word."""
        score, tokens, model = [0.0], [0], self.model
        for i in range(1, len(word) + 1):
            size = len(word[i - 1].encode("utf-8", "surrogatepass"))
            best, count = score[i - 1] + size * model.byte_score, tokens[i - 1] + size
            for n in range(1, min(i, self.longest) + 1):
                piece = model.score.get(word[i - n : i])
                if piece is not None:
                    s, c = score[i - n] + piece, tokens[i - n] + 1
                    if s > best or (s == best and c < count):
                        best, count = s, c
            score.append(best)
            tokens.append(count)
        return tokens[-1]


def _power(n: int) -> np.uint64:
    out = np.ones(1, np.uint64)
    for _ in range(n):
        out = out * _BASE
    return out[0]


class Counter:
    """Tokens of texts; remembers a bounded number of pre-tokens."""

    def __init__(self, model: Unigrams):
        self.trie = Trie(model)
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens and tokens of each text."""
        words = [t.split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = [w for text in words for w in text]
        new = list({w for w in flat if w not in self.known})
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = list(set(flat))
        if new:
            self.known.update(zip(new, self.trie.counts([MARK + w for w in new]).tolist()))
        counts = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        ends = np.append(0, np.cumsum(counts))[np.cumsum(sizes)]
        return sizes, np.diff(np.append(0, ends))


def count_tokens(docs: DataFrame, model: Unigrams, text_col: str = "text") -> DataFrame:
    """Add ``n_pretokens`` and ``n_tokens`` of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("n_pretokens long, n_tokens long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = Counter(shared.value)
        for batch in batches:
            found = [counter.count(texts) for _, texts in pieces(batch.tolist())]
            yield pd.DataFrame(
                {
                    "n_pretokens": np.concatenate([np.zeros(0, np.int64), *(a for a, _ in found)]),
                    "n_tokens": np.concatenate([np.zeros(0, np.int64), *(b for _, b in found)]),
                }
            )

    name = "__counts"
    rows = bound_batches(docs).withColumn(name, counts.asNondeterministic()(F.col(f"`{text_col}`")))
    return rows.withColumns({c: F.col(f"{name}.{c}") for c in ("n_pretokens", "n_tokens")}).drop(name)
