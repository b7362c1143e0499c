"""Byte-level BPE: encoding in batched numpy merge rounds, and decoding.

A text is cut at special tokens and then into pre-tokens (contractions, letters, digits, other
signs, white space; a space goes with what follows it). The distinct pre-tokens of a piece of text
lie in one flat symbol array. Each round looks up the ranks of neighbouring pairs by binary search
over sorted pair keys, takes the lowest rank of every word and joins all its occurrences at once.
That equals joining one occurrence at a time, because no pair that holds a joined symbol ranks below
the pair that made it; :func:`load` checks this for the vocabulary.

Defined results: a null text counts as empty and has no ids; a null id array decodes to the empty
text; texts of any length are encoded whole; rows and other columns pass through unchanged.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trimline.llm.batches import bound_batches, pieces

#: Pre-tokens whose ids a Python worker remembers, before it starts afresh.
REMEMBERED = 150_000

OTHER, LETTER, NUMBER, SPACE = range(4)

# White space of Unicode, and the letters and numbers that Unicode 16 added. The
# vocabularies are defined over Unicode 16, Python's tables may be older.
WHITE_SPACE = [
    (0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
]
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


@cache
def character_classes() -> np.ndarray:
    """The class of every code point."""
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = NUMBER
    for ranges, kind in ((WHITE_SPACE, SPACE), (NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for low, high in ranges:
            table[low : high + 1] = kind
    return table


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level BPE vocabulary as arrays."""

    tokens: list[bytes]  # bytes of each id
    bytes_to_id: np.ndarray  # id of each single byte
    pair_keys: np.ndarray  # left * size + right, sorted
    pair_ranks: np.ndarray  # rank of each key
    joined: np.ndarray  # id by rank
    special: dict[str, int]

    @property
    def size(self) -> int:
        return len(self.tokens)


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def load(path: str) -> Vocabulary:
    """Read a tokenizer file on the driver; its size is that of the vocabulary."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, letters = content["model"], _byte_letters()
    special = {t["content"]: t["id"] for t in content["added_tokens"]}
    vocab = model["vocab"]
    size = max([*vocab.values(), *special.values()]) + 1
    tokens = [b""] * size
    for token, i in vocab.items():
        tokens[i] = bytes(letters[c] for c in token)
    for token, i in special.items():
        tokens[i] = token.encode()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left = np.array([vocab[a] for a, _ in merges], np.int64)
    right = np.array([vocab[b] for _, b in merges], np.int64)
    joined = np.array([vocab[a + b] for a, b in merges], np.int64)
    made_at = np.full(size, -1)
    np.maximum.at(made_at, joined, np.arange(len(merges)))
    if (made_at[left] >= np.arange(len(merges))).any() or (made_at[right] >= np.arange(len(merges))).any():
        raise ValueError("a pair ranks below the pair that makes one of its symbols")
    keys = left * size + right
    order = np.argsort(keys)
    single = np.zeros(256, np.int64)
    for letter, byte in letters.items():
        single[byte] = vocab[letter]
    return Vocabulary(tokens, single, keys[order], order.astype(np.int64), joined, special)


def boundaries(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start. ``codes``: code points of all segments; ``firsts``: where segments start."""
    n = len(codes)
    kind = character_classes()[codes]
    first = np.zeros(n + 1, bool)
    first[firsts] = True
    first[n] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # white space before other characters gives up its last character
    runs = np.flatnonzero(start)  # ends with n
    run_first, run_last = runs[:-1], runs[1:] - 1
    inner = (kind[run_first] == SPACE) & ~first[runs[1:]]
    last = run_last[inner]
    start[last] = True
    plain = last[codes[last] == 0x20]
    start[plain + 1] = False
    # contractions: a lone apostrophe that no space precedes
    lone = run_first[(codes[run_first] == 0x27) & (run_first == run_last) & start[run_first]]
    taken = np.zeros(len(lone), bool)
    for ending in CONTRACTIONS:
        fits = ~taken
        for k, letter in enumerate(ending, 1):
            at = np.minimum(lone + k, n - 1)
            fits &= (lone + k < n) & (codes[at] == ord(letter)) & ~first[at]
        after = lone[fits] + 1 + len(ending)
        start[lone[fits] + 1] = False
        start[after] = True
        taken |= fits
    return np.flatnonzero(start)


def merge_rounds(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and how many belong to each word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    symbols = v.bytes_to_id[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), lengths)
    none = np.int64(len(v.joined))

    def ranks(at: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each of these positions."""
        out = np.full(len(at), none)
        inside = at < len(symbols) - 1
        at = at[inside]
        same = word[at] == word[at + 1]
        keys = symbols[at] * v.size + symbols[np.minimum(at + 1, len(symbols) - 1)]
        place = np.minimum(np.searchsorted(v.pair_keys, keys), len(v.pair_keys) - 1)
        found = same & (v.pair_keys[place] == keys)
        out[inside] = np.where(found, v.pair_ranks[place], none)
        return out

    done_symbols, done_words = [], []
    rank = ranks(np.arange(len(symbols)))
    while len(symbols):
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        sizes = np.diff(np.append(starts, len(word)))
        lowest = np.repeat(np.minimum.reduceat(rank, starts), sizes)
        idle = lowest == none
        if idle.any():
            done_symbols.append(symbols[idle])
            done_words.append(word[idle])
            go = ~idle
            symbols, word, rank, lowest = symbols[go], word[go], rank[go], lowest[go]
            if not len(symbols):
                break
        chosen = np.flatnonzero(rank == lowest)
        # of overlapping pairs (a run of one symbol) every second one is joined, from the left
        run = np.concatenate(([0], np.cumsum(np.diff(chosen) != 1)))
        run_start = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        chosen = chosen[(np.arange(len(chosen)) - run_start[run]) % 2 == 0]
        symbols[chosen] = v.joined[rank[chosen]]
        keep = np.ones(len(symbols), bool)
        keep[chosen + 1] = False
        place = np.cumsum(keep) - 1
        symbols, word, rank = symbols[keep], word[keep], rank[keep]
        at = place[chosen]
        changed = np.unique(np.concatenate((at, at[at > 0] - 1)))
        rank[changed] = ranks(changed)
    if not done_symbols:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    flat, owner = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(owner, kind="stable")
    return flat[order], np.bincount(owner, minlength=len(words))


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the spans, one span after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Encoder:
    """Encodes pieces of text; remembers a bounded number of pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def _codes(self, tokens: list[str]) -> np.ndarray:
        """The place of each pre-token in the memory; new ones are encoded together."""
        new = list(dict.fromkeys(t for t in tokens if t not in self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self._forget()
            new = list(dict.fromkeys(tokens))
        if new:
            flat, lengths = merge_rounds([t.encode() for t in new], self.v)
            self.known.update(zip(new, range(len(self.length), len(self.length) + len(new))))
            self.start = np.append(self.start, len(self.flat) + np.cumsum(lengths) - lengths)
            self.length = np.append(self.length, lengths)
            self.flat = np.append(self.flat, flat)
        return np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if any(s in t for s in self.v.special for t in texts):
            return [self._with_special(t) for t in texts]
        return self._plain(texts)

    def _with_special(self, text: str) -> bytes:
        """The leftmost special token, the longer one first, cuts the text."""
        out, at = [], 0
        while True:
            found = [(text.find(s, at), -len(s), s) for s in self.v.special if s in text[at:]]
            if not found:
                return b"".join([*out, *self._plain([text[at:]])])
            place, _, token = min(found)
            out += self._plain([text[at:place]])
            out.append(np.array([self.v.special[token]], "<u4").tobytes())
            at = place + len(token)

    def _plain(self, texts: list[str]) -> list[bytes]:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        whole = "".join(texts)
        if not whole:
            return [b""] * len(texts)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        bounds = boundaries(codes, (ends - lengths)[lengths > 0])
        cuts = bounds.tolist()
        places = self._codes([whole[a:b] for a, b in zip(cuts, cuts[1:])])
        counts = self.length[places]
        ids = self.flat[spans(self.start[places], counts)].astype("<u4")
        after = np.append(0, np.cumsum(counts))
        at = after[np.searchsorted(bounds, np.append(0, ends))].tolist()
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]


class Decoder:
    """Decodes id arrays with a table of token bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.length = np.fromiter(map(len, vocabulary.tokens), np.int64, vocabulary.size)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(vocabulary.tokens), np.uint8)

    def decode(self, ids: bytes | None) -> str:
        at = np.frombuffer(ids or b"", "<u4")
        picked = self.bytes[spans(self.start[at], self.length[at])]
        return picked.tobytes().decode("utf-8", errors="replace")


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add ``ids_col``: the ids of the whole text, as little-endian unsigned 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(shared.value)
        for batch in batches:
            out: list[bytes] = []
            for _, texts in pieces(batch.tolist()):
                out += encoder.encode(texts)
            yield pd.Series(out, dtype=object)

    return bound_batches(docs).withColumn(ids_col, ids.asNondeterministic()(F.col(f"`{text_col}`")))


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add ``text_col``: the text that the ids stand for, special tokens included."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(shared.value)
        for batch in batches:
            yield pd.Series([decoder.decode(x) for x in batch], dtype=object)

    return bound_batches(rows).withColumn(text_col, text.asNondeterministic()(F.col(f"`{ids_col}`")))


def digests(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids and decoded texts, made and then digested."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = decode(encode(rows, vocabulary).select("doc_id", "ids"), vocabulary)
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
