"""Substring deduplication: repeated passages found with prefix-partitioned suffix trees over words.

A passage repeats if ``min_words`` consecutive words stand somewhere earlier: in a document with a smaller
id, or further to the front of the same one. Words that such a repeat covers are removed.

1. *Anchors.* Of the grams of ``GRAM`` words in every window of ``min_words``, the one with the smallest
   hash is the window's anchor. Equal windows have equal anchors, so a window whose anchor gram occurs
   once in the corpus cannot repeat. Only anchors are shuffled (about one for seven words), and the suffixes
   that start at anchors of other windows are never looked at again.
2. *Prefix groups.* The remaining suffixes are grouped by their anchor gram, the prefix of their group.
   A prefix that more than ``group_rows`` suffixes share is made longer: to all words of the anchor's
   windows, by 128-bit digests that are reduced before the shuffle, which leaves one of equal suffixes. If
   too many distinct ones are left, it becomes the whole window of ``min_words`` words, reduced likewise.
   A passage that stands in a third of all documents thus never meets in one task.
3. *Subtrees.* All other groups fit into memory. The suffix tree of a group is held as its sorted suffixes
   with the depth that neighbours share; runs of depth ``min_words`` or more are its deep internal nodes.
   Real words are compared. In each node the first occurrence stays and the others are repeats.

Defined results: a null or empty text has no words; a null id comes after all others; rows that repeat an
id and a text are one place, so neither removes the other; white space is ASCII and a kept text has its
words joined by one space; texts of any length are worked whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trimline.llm.batches import bound_batches, pieces
from trimline.scratch import discard, release, written

MIN_WORDS, GRAM = 20, 8
#: Suffixes that share an anchor gram, up to which their subtree is built in memory.
GROUP_ROWS = 2_000
#: Suffixes in one round of subtrees.
ROUND = 200_000

_LAST = (1 << 63) - 1  # stands for a null id in orders and joins
_MIX = np.random.default_rng(20).integers(1, 1 << 63, 2 + GRAM, dtype=np.uint64) | np.uint64(1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    base = int(_MIX[0])
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        powers = np.full(n, np.uint64(b))
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x9, 0xA, 0xB, 0xC, 0xD]] = True


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of all texts, and how many words each text has."""
    parts = [t.encode() for t in texts]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    size = 1 << max(16, int(len(raw)).bit_length())
    powers, inverse = _powers(size)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=sums[1:])
    hashes = _mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _MIX[1])
    text_ends = np.cumsum(lengths + 1)
    counts = np.diff(np.searchsorted(starts, np.concatenate(([0], text_ends))))
    return hashes, counts


def anchors(texts: list[str], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram hash, first window, windows) of every anchor; windows count from the text's first word."""
    hashes, counts = word_hashes(texts)
    n, span = len(hashes), min_words - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < min_words:
        return none, none, none, none
    grams = np.zeros(n - GRAM + 1, np.uint64)
    for j in range(GRAM):
        grams += hashes[j : n - GRAM + 1 + j] * _MIX[2 + j]
    grams = _mixed(grams)
    windows = n - min_words + 1
    lowest = grams[:windows].copy()
    for j in range(1, span):
        np.minimum(lowest, grams[j : windows + j], out=lowest)
    at = np.zeros(windows, np.int64)
    for j in range(span - 1, -1, -1):
        at = np.where(grams[j : windows + j] == lowest, j, at)
    at += np.arange(windows)
    owner = np.repeat(np.arange(len(counts)), counts)
    first_word = np.cumsum(counts) - counts
    whole = np.flatnonzero(owner[:windows] == owner[min_words - 1 :])
    at = at[whole]
    if not len(whole):
        return none, none, none, none
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (owner[whole][1:] != owner[whole][:-1])))
    begin = np.flatnonzero(new)
    text = owner[whole[begin]]
    sizes = np.diff(np.append(begin, len(whole)))
    return text, grams[at[begin]].view(np.int64), whole[begin] - first_word[text], sizes


def repeated_windows(words: np.ndarray, min_words: int, order: np.ndarray) -> np.ndarray:
    """Which suffixes are repeats: ``words`` has their first words, ``order`` their places as rows of integers.

    Sorts the suffixes and takes the depth shared by neighbours; a node of full depth is a run of equals.
    """
    bits = max(1, int(words.max(initial=0)).bit_length())
    each = max(1, 63 // bits)  # word numbers that fit in one integer
    packed = [
        sum(words[:, j + i].astype(np.int64) << (bits * i) for i in range(min(each, min_words - j)))
        for j in range(0, min_words, each)
    ]
    place = np.lexsort((*order.T[::-1], *packed[::-1]))
    same = np.ones(len(place) - 1, bool)
    for column in packed:
        same &= column[place][1:] == column[place][:-1]
    start = np.concatenate(([True], ~same))
    first = place[np.flatnonzero(start)[np.cumsum(start) - 1]]  # the earliest of the node
    out = np.zeros(len(place), bool)
    out[place] = (order[place] != order[first]).any(axis=1)
    return out


def _runs(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of set flags within one owner."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = np.concatenate(([True], (np.diff(at) != 1) | (owner[at][1:] != owner[at][:-1])))
    begin = np.flatnonzero(new)
    return at[begin], np.diff(np.append(begin, len(at)))


def _subtrees(records: pd.DataFrame, min_words: int) -> pd.DataFrame:
    """Repeats (d, k, first, n) among the suffixes of whole prefix groups."""
    split = [w.split(b" ") for w in records["words"]]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [w for s in split for w in s]
    numbers = pd.factorize(flat)[0]
    windows = sizes - min_words + 1
    owner = np.repeat(np.arange(len(split)), windows)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(np.cumsum(sizes) - sizes, windows) + within
    words = numbers[at[:, None] + np.arange(min_words)]
    d = records["d"].to_numpy(np.int64)[owner]
    begin = records["first"].to_numpy(np.int64)[owner] + within
    repeat = repeated_windows(words, min_words, np.stack([d, begin], axis=1))
    run, n = _runs(repeat, owner)
    return pd.DataFrame({"d": d[run], "k": records["k"].to_numpy(np.int64)[owner[run]], "first": begin[run], "n": n})


def repeats(rows: DataFrame, min_words: int = MIN_WORDS, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """(staged, spans) of rows (d, k, text): the rows with their candidate grams, and the repeated windows.

    ``staged`` adds ``grams`` and ``large`` (null where no window can repeat); ``spans`` is (d, k, first, n):
    windows ``first`` to ``first + n - 1`` of the row (d, k) are repeats.
    """
    spark = rows.sparkSession

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = batch["d"].to_numpy(np.int64)
            for base, texts in pieces(batch["text"].tolist()):
                text, gram, _, _ = anchors(texts, min_words)
                yield pd.DataFrame({"gram": gram, "d": d[base + text]})

    found = written(bound_batches(rows).select("d", "text").mapInPandas(find, "gram long, d long"), "anchors")
    several = found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1")
    several = written(several, "grams")
    gram, large = F.col("gram"), F.col("n") > group_rows
    lists = (
        found.join(several, "gram")
        .groupBy("d")
        .agg(F.collect_set(F.when(~large, gram)).alias("grams"), F.collect_set(F.when(large, gram)).alias("large"))
    )
    lists = written(lists, "candidates")
    discard(found)
    discard(several)
    release(spark)
    staged = written(rows.join(lists, "d", "left"), "staged")
    release(spark)

    def suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The suffixes of small groups: from the first to the last word of an anchor's windows."""
        for batch in batches:
            for base, texts in pieces(batch["text"].tolist()):
                text, gram, first, n = anchors(texts, min_words)
                out, held = [], (-1, None, None)
                for t, g, f, m in zip(text.tolist(), gram.tolist(), first.tolist(), n.tolist()):
                    if held[0] != t:
                        held = (t, set(batch["grams"].iat[base + t]), texts[t].encode().split())
                    if g in held[1]:
                        words = b" ".join(held[2][f : f + m + min_words - 1])
                        out.append((g, batch["d"].iat[base + t], batch["k"].iat[base + t], f, words))
                yield pd.DataFrame(out, columns=["gram", "d", "k", "first", "words"])

    def long_suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The suffixes of large groups, with the digest of all words of an anchor's windows."""
        import xxhash

        for batch in batches:
            for base, texts in pieces(batch["text"].tolist()):
                text, gram, first, n = anchors(texts, min_words)
                out, held = [], (-1, None, None)
                for t, g, f, m in zip(text.tolist(), gram.tolist(), first.tolist(), n.tolist()):
                    if held[0] != t:
                        held = (t, set(batch["large"].iat[base + t]), texts[t].encode().split())
                    if g in held[1]:
                        words = b" ".join(held[2][f : f + m + min_words - 1])
                        digest = xxhash.xxh3_128_digest(words)
                        out.append((g, digest, batch["d"].iat[base + t], batch["k"].iat[base + t], f, m, words))
                yield pd.DataFrame(out, columns=["gram", "digest", "d", "k", "first", "n", "words"])

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every window of a suffix, by the digest of its words."""
        import xxhash

        for batch in batches:
            out = []
            for d, k, first, words in zip(batch["d"], batch["k"], batch["first"], batch["words"]):
                split = words.split(b" ")
                for s in range(len(split) - min_words + 1):
                    out.append((xxhash.xxh3_128_digest(b" ".join(split[s : s + min_words])), d, k, first + s))
            yield pd.DataFrame(out, columns=["digest", "d", "k", "first"])

    def trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole groups, as the partition is sorted by gram."""
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= ROUND // 8:
                block = pd.concat(held, ignore_index=True)
                cut = int(np.searchsorted(block["gram"].to_numpy(), block["gram"].iat[-1]))
                if cut:
                    yield _subtrees(block.iloc[:cut], min_words)
                held, size = [block.iloc[cut:]], len(block) - cut
        if size:
            yield _subtrees(pd.concat(held, ignore_index=True), min_words)

    kind = "d long, k long, first long, n long"
    columns = staged.select("d", "k", "text", "grams", "large")
    small = columns.filter(F.size("grams") > 0).mapInPandas(suffixes, "gram long, d long, k long, first long, words binary")
    # large groups, the prefix made longer: first to all words of the anchor's windows. Equal suffixes are
    # one, found before the shuffle; what follows the earliest of them is a repeat as a whole
    long = columns.filter(F.size("large") > 0).mapInPandas(
        long_suffixes, "gram long, digest binary, d long, k long, first long, n long, words binary"
    )
    long = written(long.withColumn("place", _place()), "long-suffixes")
    member = F.struct("d", "k", "first", "words")
    heads = long.groupBy("gram", "digest").agg(F.min("place").alias("earliest"), F.min_by(member, "place").alias("r"))
    heads = written(heads, "distinct-suffixes")
    known = heads.select("gram", "digest", "earliest", F.col("r.k").alias("head"))
    copies = long.drop("words").join(known, ["gram", "digest"]).filter("place > earliest").select("d", "k", "first", "n")
    # rows that repeat an id and differ elsewhere share the earliest place: each is looked at
    level = long.join(known.withColumnRenamed("earliest", "place"), ["gram", "digest", "place"]).filter("k != head")
    distinct = heads.select("gram", "r.*").unionByName(level.select("gram", "d", "k", "first", "words").distinct())
    crowds = written(distinct.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > group_rows), "crowds")
    # groups of few distinct suffixes have their subtrees; in the rest the prefix becomes the whole window
    few = distinct.join(crowds, "gram", "left_anti").select("gram", "d", "k", "first", "words")
    many = distinct.join(crowds, "gram", "left_semi")
    single = many.select("d", "k", "first", "words").mapInPandas(windows, "digest binary, d long, k long, first long")
    single = written(single.withColumn("place", _place()), "windows")
    earliest = written(single.groupBy("digest").agg(F.min("place").alias("earliest")), "earliest")
    later = single.join(earliest, "digest").filter("place > earliest")

    grouped = small.unionByName(few).repartition(F.col("gram")).sortWithinPartitions("gram")
    by_tree = grouped.mapInPandas(trees, kind)
    one = F.lit(1).cast("long").alias("n")
    return staged, by_tree.unionByName(copies).unionByName(later.select("d", "k", "first", one))


def _place():
    """Document and word as one number, so that minima are taken before the shuffle."""
    documents = F.col("d").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)")
    return (documents + F.col("first").cast("decimal(20,0)")).cast("decimal(38,0)")


def kept_words(text: str, first: list[int], n: list[int], min_words: int) -> tuple[str, int, int]:
    """What is left of a text, its words and its removed words."""
    words = text.encode().split()
    cover = np.zeros(len(words) + 1, np.int64)
    begin, end = np.asarray(first, np.int64), np.asarray(first, np.int64) + np.asarray(n, np.int64) + min_words - 1
    np.add.at(cover, begin, 1)
    np.add.at(cover, end, -1)
    gone = np.cumsum(cover)[:-1] > 0
    kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
    return kept.decode(), len(words), int(gone.sum())


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per input row: doc_id, kept (text), n_words, n_removed."""
    if min_words <= GRAM:
        raise ValueError(f"a repeat has more than {GRAM} words")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    ids = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(
        ids.alias("doc_id"), F.coalesce(ids, F.lit(_LAST)).alias("d"), F.xxhash64(text).alias("k"), text.alias("text")
    )
    staged, spans = repeats(rows, min_words, group_rows)
    marks = spans.groupBy("d", "k").agg(F.collect_set(F.struct("first", "n")).alias("m"))
    marks = written(marks, "repeats")

    spaced = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))
    number = F.when(spaced == "", 0).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1)
    whole = [spaced.alias("kept"), number.cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed")]
    clear = staged.filter("grams is null").select("doc_id", *whole)

    @F.pandas_udf("kept string, n_words long, n_removed long")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = [
            kept_words(t, [x["first"] for x in s], [x["n"] for x in s], min_words) if s is not None and len(s) else kept_words(t, [], [], min_words)
            for t, s in zip(texts, spans)
        ]
        return pd.DataFrame(out, columns=["kept", "n_words", "n_removed"])

    held = staged.filter("grams is not null").select("doc_id", "d", "k", "text").join(marks, ["d", "k"], "left")
    cutted = held.select("doc_id", cut.asNondeterministic()("text", "m").alias("c")).select("doc_id", "c.kept", "c.n_words", "c.n_removed")
    return clear.unionByName(cutted)
