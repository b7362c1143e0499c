"""SimHash near-duplicates: fingerprints, and links between those that differ in few bits.

Links are found by the general pigeonhole principle. The 64 bits are cut into ``m`` partitions, with
correlated bits together, and partition ``i`` gets a threshold ``T_i`` of -1, 0 or 1 with
``sum(T_i) = distance - m + 1``: two fingerprints within the distance differ in at most ``T_i`` bits
in some partition. Dynamic programming over the partitions chooses the thresholds, and among the cuts
the best one, by candidate counts estimated on a bounded sample of fingerprints. A threshold of 0 probes
the partition's value; a threshold of 1 probes it once for each bit left out; -1 probes nothing.

Fingerprints with a probe in common are verified. In a bucket of up to ``pair_bucket`` fingerprints all
are compared. In a larger one each fingerprint names itself and its neighbours in the free bits, and those
that name the same one are linked: they differ in two bits at most, and none that do are missed. Work is
thus linear in the bucket, whatever its size; the sample and the thresholds decide speed, not results.

Defined results: a null text has no words; a text without words has fingerprint 0, linked like any other;
a null id has a fingerprint and no component; equal ids are one document; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trimline.llm.batches import bound_batches
from trimline.llm.components import components
from trimline.scratch import written

WORDS, SEED, DISTANCE = 3, 42, 2
#: Fingerprints in the sample that the cut and the thresholds are chosen on.
SAMPLE = 8_192
#: Fingerprints of a bucket up to which all are compared.
PAIR_BUCKET = 64
#: Cost of making and shuffling one probe, in candidate pairs.
PROBE_COST = 20.0
#: Shingles hashed at a time.
BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Bit ``i`` is set if it is set in over half of the hashes of all shingles, repeats included."""
    import xxhash

    tokens = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not tokens:
        return 0
    whole, size = b" ".join(tokens), min(words, len(tokens))
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(lengths) - 1
    first = (ends - lengths + 1)[: len(tokens) - size + 1].tolist()
    last = ends[size - 1 :].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(first), BLOCK):
        spans = zip(first[at : at + BLOCK], last[at : at + BLOCK])
        hashes = np.array([digest(whole[a:b], seed) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = WORDS, seed: int = SEED) -> Column:
    """The fingerprint of a text column as a signed 64-bit integer."""
    bound_batches(docs)

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            values = np.array([fingerprint(t, words, seed) for t in batch], np.uint64)
            yield pd.Series(values.view(np.int64))

    return prints.asNondeterministic()(F.col(f"`{text_col}`"))


# --- choice of partitions and thresholds -------------------------------------------------------


def _groups(bits: np.ndarray, m: int) -> list[list[int]]:
    """Cut the 64 bits into ``m`` partitions of equal size, the most correlated bits together."""
    with np.errstate(invalid="ignore", divide="ignore"):
        correlation = np.nan_to_num(np.abs(np.corrcoef(bits.T)))
    np.fill_diagonal(correlation, -1.0)
    sizes = [64 // m + (i < 64 % m) for i in range(m)]
    free, out = set(range(64)), []
    for size in sizes:
        rest = sorted(free)
        group = [max(rest, key=lambda b: (correlation[b, rest].max(), -b))]
        while len(group) < size:
            left = sorted(free - set(group))
            group.append(max(left, key=lambda b: (correlation[b, group].sum(), -b)))
        out.append(sorted(group))
        free -= set(group)
    return out


def _pairs(sample: np.ndarray, bits: np.ndarray, group: list[int], rows: float) -> float:
    """Estimated pairs of all fingerprints that agree in the bits of ``group``."""
    mask = np.uint64(sum(1 << b for b in group))
    _, sizes = np.unique(sample & mask, return_counts=True)
    n = len(sample)
    seen = float((sizes * (sizes - 1.0)).sum()) / max(1.0, n * (n - 1.0))
    share = bits.mean(axis=0)[group]
    return max(seen, float(np.prod(share**2 + (1 - share) ** 2))) * rows * rows / 2


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one of each dictionary, that sum to ``total`` at the least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        reached: dict[int, tuple[float, list[int]]] = {}
        for so_far, (cost, chosen) in best.items():
            for threshold, more in options.items():
                key, value = so_far + threshold, (cost + more, [*chosen, threshold])
                if key not in reached or value < reached[key]:
                    reached[key] = value
        best = reached
    return best.get(total, (float("inf"), []))


def probes(sample: np.ndarray, rows: float, distance: int = DISTANCE) -> list[int]:
    """Masks of the bits that each probe compares."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    best: tuple[float, list[int]] | None = None
    for m in range(max(1, (distance + 1) // 2), distance + 3):
        groups = _groups(bits, m)
        costs = []
        for group in groups:
            near = sum(_pairs(sample, bits, [b for b in group if b != out], rows) for out in group)
            costs.append(
                {-1: 0.0, 0: _pairs(sample, bits, group, rows) + rows * PROBE_COST, 1: near + rows * PROBE_COST * len(group)}
            )
        cost, thresholds = allocate(costs, distance - m + 1)
        masks = []
        for group, threshold in zip(groups, thresholds):
            whole = sum(1 << b for b in group)
            if threshold == 0:
                masks.append(whole)
            elif threshold == 1:
                masks += [whole & ~(1 << b) for b in group]
        if thresholds and (best is None or cost < best[0]):
            best = (cost, masks)
    return best[1]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


# --- links -------------------------------------------------------------------------------------


def links(nodes: DataFrame, distance: int = DISTANCE, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Links (a, b) that join all nodes (node, fp) within two bits; ``fp`` is distinct."""
    if distance not in (1, 2):
        raise ValueError("large buckets are worked for distances 1 and 2")
    rows = nodes.count()
    share = min(1.0, 2.0 * SAMPLE / max(1, rows))
    mixed = nodes.select("fp", F.xxhash64("fp").alias("h"))
    near = mixed.filter(F.col("h") <= int(-(2**63) + share * (2**64 - 1025))).orderBy("h").limit(SAMPLE)
    sample = np.array([r["fp"] for r in near.collect()], np.int64).view(np.uint64)  # at most SAMPLE
    masks = probes(sample, rows, distance) if len(sample) > 1 else [0]

    keys = [
        F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("value"))
        for i, mask in enumerate(masks)
    ]
    keyed = nodes.select("node", "fp", F.explode(F.array(*keys)).alias("k")).select("node", "fp", "k.slot", "k.value")
    sizes = written(keyed.groupBy("slot", "value").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    key = ["slot", "value"]

    # small buckets: compare all, at most pair_bucket in one row
    small = keyed.join(sizes.filter(F.col("n") <= pair_bucket), key, "left_semi")
    gathered = small.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("node", "fp"))).alias("m"))
    close = F.expr(
        "flatten(transform(m, x -> transform(filter(m, y -> y.node > x.node and "
        f"bit_count(x.fp ^ y.fp) <= {distance}), y -> struct(x.node as a, y.node as b))))"
    )
    compared = gathered.select(F.explode(close).alias("l")).select("l.a", "l.b")

    # large buckets: link those that name the same fingerprint among themselves and their neighbours
    large = keyed.join(sizes.filter(F.col("n") > pair_bucket), key, "left_semi")
    free = reduce(
        lambda rest, i: F.when(F.col("slot") == i, F.lit(_signed(masks[i] ^ (2**64 - 1)))).otherwise(rest),
        range(len(masks)),
        F.lit(-1).cast("long"),
    )
    flips = F.array(*[F.lit(_signed(1 << b)) for b in range(64)])
    named = F.concat(
        F.array("fp"),
        F.transform(
            F.filter(flips, lambda bit: bit.bitwiseAND(free) != 0),
            lambda bit: F.col("fp").bitwiseXOR(bit),
        ),
    )
    members = large.select("node", "slot", "fp", F.explode(named).alias("name"))
    own = F.when(F.col("name") == F.col("fp"), F.col("node"))
    # at most 65 members name one fingerprint; within one bit, one of them must be that fingerprint
    shared = members.groupBy("slot", "name").agg(
        F.min("node").alias("lowest"), F.max(own).alias("own"), F.collect_set("node").alias("all")
    )
    centre = F.col("lowest") if distance == 2 else F.col("own")
    hung = shared.filter(F.size("all") > 1).select(centre.alias("a"), F.explode("all").alias("b"))
    return compared.unionByName(hung.filter("a != b"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    seed: int = SEED,
    distance: int = DISTANCE,
    pair_bucket: int = PAIR_BUCKET,
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    prints = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), fingerprints(docs, text_col, words, seed).alias("fp")
    )
    prints = written(prints, "fingerprints")
    nodes = prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    nodes = written(nodes, "nodes")
    roots = components(links(nodes, distance, pair_bucket))
    labels = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    labels = written(labels, "labels")
    found = prints.join(labels, "fp", "left")
    hexadecimal = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(
        "doc_id",
        hexadecimal.alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def without_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int
) -> DataFrame:
    """The rows that stay, with all their columns: those with the smallest id of their component."""
    found = near_duplicates(docs, id_col, text_col, **options)
    gone = found.filter("component_id != doc_id").select(F.col("doc_id").alias("__gone"))
    gone = written(gone, "near-copies")
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col("__gone"), "left_anti")
