"""Near copies by Jaccard similarity of word shingles: SimHash links, MinHash bands, exact verification, components.

Two documents are near copies if the sets of their shingles (``words`` words, ASCII lower case) have a
Jaccard similarity of at least ``SIMILAR``. Candidates share one of ``bands()`` bands of ``ROWS`` minima:
as many as find a pair at the threshold with a probability of ``FOUND``, and a more similar pair with a
higher one. Every candidate is verified on its whole sets, so nothing is joined by chance; groups are the
connected components of the verified links.

The first candidates are the components of another operator (``linked``; the pipeline gives those of SimHash
fingerprints within two bits): each member is verified against the component's smallest id, and what is near is one
group before the first band is looked at. Fingerprints are no filter for the rest: texts at the threshold differ in 17 of
64 bits and more, where few pairs of any two texts could be ruled out, so bands find what lies beyond the two bits.

A bucket is the documents that share a band. Bands are worked in phases of 1, 3, 12, ... bands: in the first one a
document has one bucket, and what it joins needs no comparison later. In each phase the members of a bucket that are
not yet joined with its pivot (the member whose hashed id is smallest, so that buckets agree on pivots) are compared
with it, which joins most of a group of near copies in linear work. Buckets that still hold several components, and small
ones at once, are compared in blocks: members outside the largest component against all others, up to
``BLOCK`` against ``BLOCK`` at a time, where one matrix product gives all intersections. A block names at most one link for
each member, so no pair becomes a row; sets travel once for each block that they are compared with.

Defined results: texts without words are copies of each other; a text of fewer words is one shingle; a row
without an id stays; equal ids are one document with all its texts; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trimline.llm.batches import bound_batches
from trimline.llm.components import components
from trimline.llm.tables import fresh
from trimline.scratch import discard, written

WORDS, SEED, SIMILAR = 5, 42, 0.8
#: Minima in a band, and the probability of finding a pair at the threshold.
ROWS, FOUND = 6, 0.9995
#: Pairs of a bucket up to which it goes to blocks at once, and rounds with pivots in a phase before the rest does.
PAIRS, ROUNDS = 36, 1
#: Members of one side of a block, and distinct shingles in one matrix.
BLOCK, WIDTH = 256, 4096
#: Shingles that meet all hash functions at a time.
HASHED = 1 << 12


def bands(similar: float = SIMILAR) -> int:
    return math.ceil(math.log(1 - FOUND) / math.log(1 - similar**ROWS))


def phases(count: int) -> list[tuple[int, int]]:
    """(first band, band after the last one) of each phase."""
    out, first, width = [], 0, 1
    while first < count:
        out.append((first, min(count, first + width)))
        first = out[-1][1]
        width = 3 * first
    return out


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    import xxhash

    tokens = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not tokens:
        return np.zeros(0, np.uint64)
    whole, size = b" ".join(tokens), min(words, len(tokens))
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(lengths) - 1
    first = (ends - lengths + 1)[: len(tokens) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(whole[a:b], SEED) for a, b in zip(first, ends[size - 1 :].tolist())], np.uint64))


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = rng.integers(0, 1 << 64, (2, count), dtype=np.uint64)
    return draw[0] | np.uint64(1), draw[1]


def keys(grams: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band."""
    import xxhash

    lowest = np.full(len(factors), np.iinfo(np.uint64).max)
    for at in range(0, len(grams), HASHED):
        mixed = grams[at : at + HASHED, None] * factors + shifts  # modulo 2**64
        lowest = np.minimum(lowest, mixed.min(axis=0))
    rows = lowest.reshape(-1, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(rows)]


def _similar(a: np.ndarray, b: np.ndarray, similar: float) -> bool:
    if not len(a) or not len(b):
        return len(a) == len(b)
    if min(len(a), len(b)) < similar * max(len(a), len(b)) - 1e-9:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similar * (len(a) + len(b) - common) - 1e-9


def links_within(roots: np.ndarray, sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """(root, smallest root reached) of the members whose component changes; all pairs of ``sets`` are compared."""
    sizes, n = np.array([len(s) for s in sets], np.int64), len(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count[column] > 1
    owner, column = owner[several], np.unique(column[several], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n))
    for low in range(0, int(column.max(initial=-1)) + 1, WIDTH):
        a, b = np.searchsorted(column, [low, low + WIDTH])
        held = np.zeros((n, WIDTH), np.float32)  # counts stay exact below 2**24
        held[owner[a:b], column[a:b] - low] = 1
        common += held @ held.T
    near = common >= similar * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    label = roots.copy()
    while True:
        lowest = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (lowest >= label).all():
            break
        label = np.minimum(label, lowest)
    return sorted({(r, x) for r, x in zip(roots.tolist(), label.tolist()) if r != x})


def _blocks(members: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) between roots within buckets: rows of (key, node, root, n, big, big_n), compared block by block."""
    inside = F.col("root") == F.col("big")
    parts = members.withColumns({"p_in": F.ceil(F.col("big_n") / BLOCK), "p_out": F.ceil((F.col("n") - F.col("big_n")) / BLOCK)})
    parts = parts.withColumn("part", F.pmod(F.xxhash64("node"), F.when(inside, F.col("p_in")).otherwise(F.col("p_out"))))
    within = "transform(sequence(0L, p_out - 1), x -> struct(x as x, 0 as kind, part as y))"
    outside = (
        "concat(transform(sequence(0L, p_in - 1), y -> struct(part as x, 0 as kind, y as y)), "
        "transform(sequence(0L, p_out - 1), y -> struct(least(part, y) as x, 1 as kind, greatest(part, y) as y)))"
    )
    cells = F.expr(f"CASE WHEN n <= {BLOCK} THEN array(struct(0L as x, 2 as kind, 0L as y)) WHEN root = big THEN {within} ELSE {outside} END")
    dealt = parts.select("key", "node", "root", F.explode(cells).alias("cell")).join(sets, "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        found = links_within(pdf["root"].to_numpy(np.int64), [np.frombuffer(g, np.uint64) for g in pdf["grams"]], similar)
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])

    return dealt.groupBy("key", "cell").applyInPandas(compare, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """(ra, rb) of those of the pairs (a, ra, b, rb) that are near copies."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = [
                _similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similar)
                for x, y in zip(batch["x"], batch["y"])
            ]
            yield batch.loc[near, ["a", "b"]].drop_duplicates()

    left = sets.select(F.col("node").alias("pivot"), F.col("grams").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    sided = bound_batches(pairs.join(right, "b").join(left, "pivot")).select(F.col("ra").alias("a"), F.col("rb").alias("b"), "x", "y")
    return sided.mapInPandas(check, "a long, b long").distinct()


def _moved(roots: DataFrame, near: DataFrame) -> DataFrame:
    """``roots`` after the links ``near`` (a, b) between them; tables that are done with are discarded."""
    if near.limit(1).count():
        upper = components(near).select(F.col("node").alias("root"), F.col("root").alias("top"))
        moved = written(roots.join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
        discard(roots)
        roots = moved
    discard(near)
    return roots


def groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    similar: float = SIMILAR,
    pairs: int = PAIRS,
    rounds: int = ROUNDS,
    linked: DataFrame | None = None,
) -> DataFrame:
    """(node, root) of every document with a near copy; ``root`` is the smallest id of its group.

    ``linked`` has candidates of another operator: doc_id, and component_id, the doc_id of another member or its own.
    """
    bound_batches(docs)
    count = bands(similar)
    factors, shifts = _functions(count * ROWS)

    @F.pandas_udf("k array<long>, size long")
    def banded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch]
            found = pd.Series([keys(s, factors, shifts) for s in sets], dtype=object)
            yield pd.DataFrame({"k": found, "size": [len(s) for s in sets]})

    @F.pandas_udf("binary")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingles(t, words).tobytes() for t in batch], dtype=object)

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("node"), F.col(f"`{text_col}`").alias("t"))
    texts = texts.filter("node is not null")
    keyed = written(texts.select("node", banded.asNondeterministic()("t").alias("s")), "bands")
    # a key holds the number of its band
    flat = keyed.select("node", F.col("s.size").alias("size"), F.posexplode("s.k").alias("band", "key")).distinct()
    shared = flat.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x != y").select("key")
    buckets = written(flat.join(shared, "key", "left_semi"), "buckets")
    chosen, aided = buckets.select("node"), None
    if linked is not None:
        pairs_of = linked.filter("component_id != doc_id").select(
            F.col("component_id").alias("pivot"), F.col("component_id").alias("ra"), F.col("doc_id").alias("b"), F.col("doc_id").alias("rb")
        )
        aided = written(pairs_of.distinct(), "pairs")
        chosen = chosen.unionByName(aided.select(F.explode(F.array("pivot", "b")).alias("node")))
    chosen = written(chosen.distinct(), "candidates")
    sets = texts.join(chosen, "node", "left_semi").select("node", hashed.asNondeterministic()("t").alias("grams"))
    sets = written(sets, "shingles")

    roots = written(chosen.select("node", F.col("node").alias("root")), "roots")
    if aided is not None:
        roots = _moved(roots, written(_verified(aided, sets, similar), "near"))
    fits = F.least("size", "p_size") >= similar * F.greatest("size", "p_size") - 1e-9
    for first, after in phases(count):
        members = buckets.filter((F.col("band") >= first) & (F.col("band") < after)).select("key", "node", "size")
        for turn in range(rounds + 1):
            placed = members.join(roots, "node")
            first_one = F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("pivot"), F.col("root").alias("p_root"), F.col("size").alias("p_size")))
            shares = placed.groupBy("key", "root").agg(F.count("*").alias("m"), first_one.alias("p"))
            opened = shares.groupBy("key").agg(
                F.sum("m").alias("n"), F.count("*").alias("c"), F.max(F.struct("m", "root")).alias("big"), F.min("p").alias("p")
            )
            opened = opened.filter("c > 1").select("key", "n", F.col("big.root").alias("big"), F.col("big.m").alias("big_n"), "p.pivot", "p.p_root", "p.p_size")
            opened = written(placed.join(opened, "key").withColumn("full", (F.col("n") * F.col("n") <= pairs) | F.lit(turn == rounds)), "open")
            if not opened.limit(1).count():
                break
            aimed = opened.filter(~F.col("full") & (F.col("root") != F.col("p_root")) & fits)
            aimed = aimed.select("pivot", F.col("p_root").alias("ra"), F.col("node").alias("b"), F.col("root").alias("rb"))
            tried = written(aimed.distinct(), "pairs")
            blocks = _blocks(opened.filter("full"), sets, similar)
            # links are drawn between the components so far
            near = written(_verified(tried, sets, similar).unionByName(blocks), "near")
            roots = _moved(roots, near)
            members = written(opened.filter("not full and node != pivot").select("key", "node", "size"), "buckets")
            for table in (opened, tried):
                discard(table)
    return roots


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, with all their columns: those with the smallest id of their group."""
    name = fresh(docs, "gone")
    gone = groups(docs, id_col, text_col, **options).filter("node != root").select(F.col("node").alias(name))
    gone = written(gone, "near-copies")
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(name), "left_anti")
