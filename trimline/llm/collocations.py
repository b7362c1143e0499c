"""Phrase collocation mining: multikey three-way quicksort of suffix pointers, routed by leading words.

Every word begins a suffix of at most ``LONGEST`` words of its piece of text. Words are held as 64-bit hashes;
the table of all distinct words shows that no two of them share a hash, otherwise another seed is taken, so
counts are exact. A first pass counts words; a suffix ends before a word with fewer than ``least``
occurrences, because no phrase with it is frequent (a bit map of fixed size tells most such words apart; those
it lets through cost time only), and suffixes of one word are left out.

Suffixes are routed to buckets by their first two words. In a bucket, pointers to suffixes are sorted by
three-way partitions, word by word to the maximum depth: the weight of a partition of equal words is the
count of that phrase, and a partition below ``least`` is abandoned. A bucket that holds too many suffixes is
routed anew by three words, then by four; its shorter phrases travel as counted suffixes of their own. Equal
suffixes met together are one with a weight, so frequent phrases are merged before every shuffle.

A candidate is cut after each of its words but the last: with ``l`` and ``r`` occurrences of the two parts the
score is floor(2000000 * a / (l + r)), and the lowest cut counts (ties: the shortest first part). Candidates
that lie within a longer one with at least ``share`` percent of their occurrences are dropped.

Defined results: a null text is empty; a null language is ``und``; rows that repeat count each time; words are
compared byte by byte after lower-casing A-Z; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trimline.llm.batches import bound_batches
from trimline.scratch import discard, written

LEAST, LONGEST, TOP, SHARE, SCORE = 30, 4, 2000, 80, 2_000_000
UNKNOWN = "und"
#: Suffixes in a bucket, and how many times as many are too many.
BUCKET, CROWDED = 1 << 18, 4
#: Suffixes held by a task before they are sorted and sent on, and bytes of text worked on at a time.
HELD, CHUNK = 1 << 19, 1 << 20
#: Tasks that sort the buckets of one round, at most; a task takes one bucket after the other.
MOST_TASKS = 1 << 15
#: Distinct words counted by a task before they are sent on.
COUNTED = 1 << 18
#: Bits of the map of frequent words.
MAP_BITS = 1 << 25

_END = b"\n"
_UPPER = bytes(range(65, 91))
_BYTES = bytes.maketrans(_UPPER + b".,;:!?\x0b\x0c\x0d\x09", _UPPER.lower() + _END * 9 + b" ")
_GAP = re.compile(rb"[ \n]")
_PACKED = "bucket long, lang string, depth int, size long, words binary, weights binary"


def _chunks(texts: Iterator[str | None]) -> Iterator[bytes]:
    """Texts with piece ends as line feeds, about CHUNK bytes at a time, cut between words only."""
    held, size = [], 0
    for text in texts:
        data = (text or "").encode().translate(_BYTES) + _END
        at = 0
        while at < len(data):
            cut = len(data)
            if size + cut - at > CHUNK:
                gap = _GAP.search(data, min(cut - 1, at + max(0, CHUNK - size)))
                cut = gap.end() if gap else cut
            held.append(data[at:cut])
            size, at = size + cut - at, cut
            if size >= CHUNK:
                yield b"".join(held)
                held, size = [], 0
    if held:
        yield b"".join(held)


def _words(chunk: bytes) -> list[bytes]:
    """The words of a chunk, with _END between pieces."""
    return list(filter(None, chunk.replace(_END, b" \n ").split(b" ")))


def _by_language(batch: pd.DataFrame) -> Iterator[tuple[str, Iterator[str | None]]]:
    for lang, part in batch.groupby("lang", sort=False)["text"]:
        yield lang, part.to_numpy()


def _mixed(columns: list[np.ndarray], lang: str) -> np.ndarray:
    import xxhash

    out = np.full(len(columns[0]), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    for c in columns:
        out = (out ^ c) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _merged(words: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal suffixes as one, in order of their words; ``words`` has a row for each depth."""
    order = np.lexsort(words[::-1])
    words, weights = words[:, order], weights[order]
    new = np.ones(words.shape[1], bool)
    new[1:] = (words[:, 1:] != words[:, :-1]).any(axis=0)
    return words[:, new], np.add.reduceat(weights, np.flatnonzero(new)) if len(weights) else weights


def _routed(words: np.ndarray, weights: np.ndarray, lang: str, depth: int, buckets: int) -> list[tuple]:
    """Packed rows, one for each bucket that the first ``depth`` words lead to."""
    if not words.shape[1]:
        return []
    words, weights = _merged(words, weights)
    bucket = (_mixed(list(words[:depth]), lang) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    words, weights, bucket = words[:, order], weights[order], bucket[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    # buckets of different depths have different numbers
    return [
        (int(bucket[a]) * (LONGEST + 1) + depth, lang, depth, b - a, words[:, a:b].tobytes(), weights[a:b].tobytes())
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)])
    ]


def _unpacked(words: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    w = np.frombuffer(weights, np.int64)
    return np.frombuffer(words, np.uint64).reshape(LONGEST, len(w)), w


def equal_partitions(words: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, a pointer, weight) of all partitions of equal words with a weight of ``least``.

    ``words[d]`` holds the words at depth ``d`` of all suffixes, 0 after the last one.
    """
    open_ = [(np.arange(words.shape[1]), 0)] if weights.sum() >= least else []
    while open_:
        at, depth = open_.pop()
        key = words[depth][at]
        a, b, c = key[0], key[len(key) // 2], key[-1]
        pivot = max(min(a, b), min(max(a, b), c))
        same = key == pivot
        if same.all():
            equal, size = at, int(weights[at].sum())
        else:
            below = key < pivot
            for side in (at[below], at[~(below | same)]):
                if len(side) and weights[side].sum() >= least:
                    open_.append((side, depth))
            equal = at[same]
            size = int(weights[equal].sum())
        if pivot and size >= least:
            yield depth + 1, int(equal[0]), size
            if depth + 1 < len(words):
                open_.append((equal, depth + 1))


def _word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, hash, n) of all distinct words."""
    import xxhash

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, Counter] = defaultdict(Counter)

        def sent() -> pd.DataFrame:
            rows = [(lang, w, n) for lang, words in found.items() for w, n in words.items() if w != _END]
            found.clear()
            hashes = np.array([xxhash.xxh64_intdigest(w, seed) for _, w, _ in rows], np.uint64).view(np.int64)
            names = [(lang, w.decode(), n) for lang, w, n in rows]
            return pd.DataFrame(names, columns=["lang", "word", "n"]).assign(hash=hashes)

        for batch in batches:
            for lang, texts in _by_language(batch):
                for chunk in _chunks(texts):
                    found[lang].update(_words(chunk))
            if sum(map(len, found.values())) > COUNTED:
                yield sent()
        yield sent()

    counts = docs.mapInPandas(count, "lang string, word string, n long, hash long")
    return counts.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.first("hash").alias("hash"))


def _bit_map(frequent: DataFrame) -> np.ndarray:
    """MAP_BITS bits, those of frequent words set; comes to the driver in pieces of 4 KB."""
    slot = F.col("hash").bitwiseAND(MAP_BITS - 1) + 1
    pieces = frequent.select(F.bitmap_bucket_number(slot).alias("b"), F.bitmap_bit_position(slot).alias("p"))
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for r in pieces.groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect():
        at = (r["b"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["m"], np.uint8)
    return out


def _suffixes(docs: DataFrame, frequent_bits: np.ndarray, seed: int, buckets: int) -> DataFrame:
    """Packed suffixes of two and more words, routed by two."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_bits)

    def suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        bits, digest = shared.value, xxhash.xxh64_intdigest
        end = np.uint64(digest(_END, seed))
        held: dict[str, list[np.ndarray]] = defaultdict(list)
        rest: dict[str, np.ndarray] = {}
        n = 0

        def sent() -> pd.DataFrame:
            rows = []
            for lang, parts in held.items():
                words = np.concatenate(parts, axis=1)
                rows += _routed(words, np.ones(words.shape[1], np.int64), lang, 2, buckets)
            held.clear()
            return pd.DataFrame(rows, columns=["bucket", "lang", "depth", "size", "words", "weights"])

        for batch in batches:
            for lang, texts in _by_language(batch):
                for chunk in _chunks(texts):
                    ids = np.fromiter(map(digest, _words(chunk), itertools.repeat(seed)), np.uint64)
                    slot = ids & np.uint64(MAP_BITS - 1)
                    rare = (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 0
                    ids[rare | (ids == end)] = 0
                    # the last words wait for those of the next chunk
                    ids = np.concatenate([rest.get(lang, np.zeros(0, np.uint64)), ids])
                    rest[lang] = ids[len(ids) - min(len(ids), LONGEST - 1) :]
                    last = max(0, len(ids) - LONGEST + 1)
                    held[lang].append(_windows(ids, last))
                    n += held[lang][-1].shape[1]
                    if n >= HELD:
                        yield sent()
                        n = 0
        for lang, ids in rest.items():
            held[lang].append(_windows(np.concatenate([ids, np.zeros(LONGEST - 1, np.uint64)]), len(ids)))
        yield sent()

    return docs.mapInPandas(suffixes, _PACKED)


def _windows(ids: np.ndarray, count: int) -> np.ndarray:
    """The suffixes that begin at the first ``count`` words, without those of fewer than two words."""
    words = np.zeros((LONGEST, count), np.uint64)
    for d in range(LONGEST):
        words[d] = ids[d : d + count]
        if d:
            words[d][words[d - 1] == 0] = 0
    return words[:, words[1] != 0]


def _deeper(crowded: DataFrame, buckets: int) -> DataFrame:
    """Suffixes of crowded buckets routed by one more word; their shorter phrases go as suffixes of their own."""

    def deepen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                words, weights = _unpacked(r.words, r.weights)
                short = words.copy()
                short[r.depth :] = 0
                rows += _routed(short, weights, r.lang, r.depth, buckets)
                longer = words[r.depth] != 0
                rows += _routed(words[:, longer], weights[longer], r.lang, r.depth + 1, buckets)
            yield pd.DataFrame(rows, columns=["bucket", "lang", "depth", "size", "words", "weights"])

    return bound_batches(crowded).mapInPandas(deepen, _PACKED)


def _counted(packed: DataFrame, least: int, tasks: int) -> DataFrame:
    """(lang, p, a): phrases as arrays of hashes and their counts, each bucket sorted on its own."""

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpacked(w, c) for w, c in zip(pdf["words"], pdf["weights"])]
        words, weights = np.concatenate([w for w, _ in parts], axis=1), np.concatenate([c for _, c in parts])
        found = [f for f in equal_partitions(words, weights, least) if f[0] >= max(2, int(pdf["depth"].iat[0]))]
        signed = words.view(np.int64)
        phrases = pd.Series([signed[:d, at] for d, at, _ in found], dtype=object)
        return pd.DataFrame({"lang": key[1], "p": phrases, "a": pd.Series([n for *_, n in found], dtype=np.int64)})

    dealt = packed.repartition(min(tasks, MOST_TASKS), "bucket", "lang")
    return dealt.groupBy("bucket", "lang").applyInPandas(count, "lang string, p array<long>, a long")


def phrase_counts(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    bucket: int = BUCKET,
) -> tuple[DataFrame, DataFrame]:
    """(lang, word, n, hash) of all words, and (lang, p, a) of all phrases of two and more words with ``least``."""
    docs = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text_col}`").alias("text")
    )
    bound_batches(docs)
    for seed in itertools.count():
        words = written(_word_counts(docs, seed), "words")
        taken = words.groupBy("hash").agg(F.min("word").alias("x"), F.max("word").alias("y"))
        import xxhash

        reserved = [0, int(np.uint64(xxhash.xxh64_intdigest(_END, seed)).astype(np.int64))]
        if not taken.filter((F.col("x") != F.col("y")) | F.col("hash").isin(reserved)).limit(1).count():
            break
        discard(words)
    frequent = words.filter(F.col("n") >= least)
    total = frequent.agg(F.sum("n")).first()[0] or 0
    buckets, tasks = max(1, -(-total // bucket)), max(1, -(-total // BUCKET))
    packed = written(_suffixes(docs, _bit_map(frequent), seed, buckets), "suffixes")
    tables, found = [packed], None
    for depth in range(2, LONGEST + 1):
        if depth == LONGEST:
            ordinary = packed
        else:
            sizes = packed.groupBy("bucket").agg(F.sum("size").alias("s")).filter(F.col("s") > CROWDED * bucket)
            crowded = written(sizes.select("bucket"), "crowded")
            ordinary = packed.join(crowded, "bucket", "left_anti")
        here = written(_counted(ordinary, least, tasks), "phrases")
        found = here if found is None else found.unionByName(here)
        if depth == LONGEST or not crowded.limit(1).count():
            break
        packed = written(_deeper(packed.join(crowded, "bucket", "left_semi"), buckets), "suffixes")
        tables.append(packed)
    for t in tables:
        discard(t)
    return words, found


def mine(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    top: int = TOP,
    share: int = SHARE,
    bucket: int = BUCKET,
) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    words, phrases = phrase_counts(docs, text_col, lang_col, least, bucket)
    frequent = words.filter(F.col("n") >= least).select("lang", F.array("hash").alias("p"), F.col("n").alias("f"))
    sizes = frequent.unionByName(phrases.select("lang", "p", F.col("a").alias("f")))
    cut = "explode(transform(sequence(1, size(p) - 1), k -> struct(k, slice(p, 1, k) as x, slice(p, k + 1, size(p) - k) as y)))"
    cuts = phrases.select("lang", "p", "a", F.expr(cut).alias("c")).select("lang", "p", "a", "c.k", "c.x", "c.y")
    first = sizes.withColumnsRenamed({"p": "x", "f": "l"})
    second = sizes.withColumnsRenamed({"p": "y", "f": "r"})
    score = F.expr(f"cast(a as decimal(20, 0)) * {SCORE} div (l + r)")  # decimals: the product may pass 64 bits
    cuts = cuts.join(first, ["lang", "x"]).join(second, ["lang", "y"]).withColumn("score", score)
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("c")
    scored = cuts.groupBy("lang", "p").agg(F.first("a").alias("a"), lowest).select("lang", "p", "a", "c.score", "c.l", "c.r")

    part = "explode(flatten(transform(sequence(2, size(p) - 1), n -> transform(sequence(1, size(p) - n + 1), i -> slice(p, i, n)))))"
    parts = phrases.filter(F.size("p") > 2).select("lang", F.expr(part).alias("p"), F.col("a").alias("longer"))
    parts = parts.groupBy("lang", "p").agg(F.max("longer").alias("longer"))
    whole = F.expr(f"cast(longer as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {int(share)}")
    kept = scored.join(parts, ["lang", "p"], "left").filter(F.col("longer").isNull() | ~whole).drop("longer")
    kept = written(kept, "kept")

    named = words.filter(F.col("n") >= least).select("lang", "hash", "word")
    spelt = kept.select("lang", "p", F.posexplode("p").alias("i", "hash")).join(named, ["lang", "hash"])
    spelt = spelt.groupBy("lang", "p").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w"))
    spelt = spelt.select("lang", "p", F.array_join("w.word", " ").alias("phrase"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.join(spelt, ["lang", "p"]).withColumn("rank", F.row_number().over(order).cast("long"))
    ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
