"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

The trees are complete binary trees of hyperplanes. They are fitted on the driver on a bounded,
documented sample (``sample_rows`` vectors, fewer for long vectors), and every vector is then put in
its leaf of every tree. A query searches all trees through one priority queue: the node with the
largest margin over all trees is opened next, until the leaves taken hold ``search_rows`` vectors (by default
``SEARCH_SHARE`` of all points, summed over the trees, and ``SEARCH_ROWS`` at least).
Queries and members meet by leaf, and the leaf's members are ranked by their exact cosine.

Equal vectors are one point that carries its smallest ids, so a vector that fills a third of the table
is one point, and queries with equal vectors are searched once. A leaf above ``chunk_rows`` points is
split; its queries go to all parts.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do
rows without an id and vectors of another length than the most frequent one (the smaller of two). Rows
that repeat an id count once. Ties go to the smaller id. Queries with fewer than ``k`` others get all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trimline.scratch import written

TREES = 16
LEAF_ROWS = 256
#: Leaf members that a query meets: a share of all points, a copy in each tree counted, and the least number.
SEARCH_SHARE, SEARCH_ROWS = 0.5, 40_000
SAMPLE_ROWS = 16_384
#: Numbers in the sample, whatever the length of a vector.
SAMPLE_VALUES = 1 << 23
CHUNK_ROWS = 20_000
#: Leaf members whose product is so close to that of the last one wanted get exact scores, too.
ROUNDING = 1e-9


@dataclass(frozen=True)
class Forest:
    """Complete trees; node ``i`` has children ``2i + 1`` and ``2i + 2``."""

    depth: int
    normals: np.ndarray  # trees, inner nodes, dimension
    offsets: np.ndarray  # trees, inner nodes

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(unit), len(self.normals)), np.int64)
        for t, (normals, offsets) in enumerate(zip(self.normals, self.offsets)):
            node = np.zeros(len(unit), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", unit, normals[node]) > offsets[node]
                node = 2 * node + 1 + side
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def search(self, vector: np.ndarray, sizes: np.ndarray, wanted: int) -> list[tuple[int, int]]:
        """(tree, leaf) by one priority queue over all trees, until ``wanted`` rows are gathered."""
        inner = (1 << self.depth) - 1
        queue = [(-np.inf, t, 0) for t in range(len(self.normals))]
        taken, rows = [], 0
        while queue and rows < wanted:
            margin, t, node = heapq.heappop(queue)
            if node >= inner:
                if sizes[t, node - inner]:
                    taken.append((t, node - inner))
                    rows += int(sizes[t, node - inner])
                continue
            side = float(self.normals[t, node] @ vector) - float(self.offsets[t, node])
            heapq.heappush(queue, (max(margin, -side), t, 2 * node + 2))
            heapq.heappush(queue, (max(margin, side), t, 2 * node + 1))
        return taken


def budget(points: int) -> int:
    """Leaf members that a query meets among so many points."""
    return max(SEARCH_ROWS, int(SEARCH_SHARE * points))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled first, so that no square passes the range of a double. Zero stays zero."""
    largest = np.abs(vectors).max(axis=1, keepdims=True, initial=0.0)
    scaled = vectors / np.where(largest > 0, largest, 1.0)
    return scaled / np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), np.finfo(float).tiny)


def _cosines(members: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Cosines computed in extended precision and rounded once, so parallel vectors tie whatever their lengths."""
    m, v = members.astype(np.longdouble), vector.astype(np.longdouble)
    return ((m * v).sum(axis=1) / (np.sqrt((m * m).sum(axis=1)) * np.sqrt((v * v).sum()))).astype(np.float64)


def levels(points: int, sampled: int, leaf_rows: int = LEAF_ROWS) -> int:
    """Depth of the trees for so many points, of which some are in the sample."""
    depth = 0
    while points / 2**depth > leaf_rows and sampled / 2 ** (depth + 1) >= 2:
        depth += 1
    return depth


def plant(sample: np.ndarray, trees: int, depth: int, seed: int = 11) -> Forest:
    """Fit the hyperplanes: between two points of the node, at the median of the node's sample."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    inner = (1 << depth) - 1
    normals, offsets = np.zeros((trees, inner, dim)), np.zeros((trees, inner))
    for t in range(trees):
        members = {0: np.arange(len(sample))}
        for node in range(inner):
            here = members.pop(node)
            normal = rng.standard_normal(dim)
            if len(here) >= 2:
                # two means of a few points each, as far apart as chance allows
                a, b = np.array_split(rng.permutation(here)[:2], 2)
                first, second = sample[a].mean(0), sample[b].mean(0)
                for _ in range(3):
                    near = sample[here] @ (first - second) > 0
                    if near.all() or not near.any():
                        break
                    first, second = _unit(np.stack([sample[here[near]].mean(0), sample[here[~near]].mean(0)]))
                if np.linalg.norm(first - second) > 0:
                    normal = first - second
            normals[t, node] = normal / np.linalg.norm(normal)
            side = sample[here] @ normals[t, node]
            offsets[t, node] = np.median(side) if len(here) else 0.0
            right = side > offsets[t, node]
            members[2 * node + 1], members[2 * node + 2] = here[~right], here[right]
    return Forest(depth, normals, offsets)


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("v")
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")
    )
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(
        F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0.0)
    )
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return rows.join(F.broadcast(sizes.select("n")), F.size("v") == F.col("n"), "left_semi")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
    leaf_rows: int = LEAF_ROWS,
    search_rows: int | None = None,
    sample_rows: int = SAMPLE_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The ``k`` nearest other rows of each query row: query_id, rank, vec_id, score.

    ``is_query`` is a condition on the input's columns.
    """
    spark = vectors.sparkSession
    rows = written(_valid(vectors, id_col, vector_col).distinct(), "vectors")
    asked = vectors.filter(is_query).select(F.col(f"`{id_col}`").cast("long").alias("vec_id")).distinct()
    asked = rows.join(asked, "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "v")

    # one point per distinct vector, with as many of its ids as any result can name
    smallest = Window.partitionBy("v").orderBy("vec_id")
    points = (
        rows.withColumn("place", F.row_number().over(smallest))
        .filter(F.col("place") <= k + 1)
        .groupBy("v")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    points = written(points.withColumn("point", F.monotonically_increasing_id()), "points")
    total, dim = points.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    wanted_rows = budget(total) if search_rows is None else search_rows
    size = max(2, min(sample_rows, SAMPLE_VALUES // dim))
    share = min(1.0, 2.0 * size / total)
    near = points.select("v", F.xxhash64("v").alias("h")).filter(F.col("h") <= int(-(2**63) + share * (2**64 - 1025)))
    # bounded by SAMPLE_VALUES numbers
    sample = np.array([r["v"] for r in near.orderBy("h", "v").limit(size).collect()], np.float64).reshape(-1, dim)
    depth = levels(total, len(sample), leaf_rows)
    forest = plant(_unit(sample), trees, depth) if len(sample) else plant(np.ones((1, dim)), trees, 0)
    shared = spark.sparkContext.broadcast(forest)

    def leaves(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(shared.value.leaves(_unit(_matrix(batch)))), dtype=object)

    leaf_ids = F.pandas_udf(leaves, "array<long>").asNondeterministic()
    placed = written(points.withColumn("leaves", leaf_ids("v")), "leaves")
    by_leaf = placed.select("v", "ids", "point", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = np.zeros((trees, 1 << depth), np.int64)
    for r in by_leaf.groupBy("tree", "leaf").count().collect():  # one row per leaf of the bounded forest
        sizes[r["tree"], r["leaf"]] = r["count"]
    parts = -(-sizes // chunk_rows)
    shared_sizes = spark.sparkContext.broadcast(sizes)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, sizes = shared.value, shared_sizes.value
        for batch in batches:
            out = []
            for q, v in zip(batch["q"], batch["v"]):
                for t, leaf in forest.search(_unit(np.asarray(v, np.float64)[None])[0], sizes, wanted_rows):
                    out += [(t, leaf, p, q, v) for p in range(-(-int(sizes[t, leaf]) // chunk_rows))]
            yield pd.DataFrame(out, columns=["tree", "leaf", "part", "q", "v"])

    asked = written(asked, "asked")
    distinct = written(
        asked.select("v").distinct().withColumn("q", F.monotonically_increasing_id()), "queries"
    )
    # a number of its own: few bytes, much work, so these tasks must not be merged
    tasks = 4 * spark.sparkContext.defaultParallelism
    probes = distinct.repartition(tasks, "q").mapInPandas(search, "tree int, leaf long, part long, q long, v array<double>")
    if parts.max() > 1:
        several = [(int(t), int(x), int(parts[t, x])) for t, x in zip(*np.nonzero(parts > 1))]
        split = spark.createDataFrame(several, "tree int, leaf long, parts long")
        members = by_leaf.join(F.broadcast(split), ["tree", "leaf"], "left")
        members = members.withColumn("part", F.pmod("point", F.coalesce("parts", F.lit(1)))).drop("parts")
    else:
        members = by_leaf.withColumn("part", F.lit(0).cast("long"))

    def rank(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(members):
            ids, m = members["ids"].tolist(), _matrix(members["v"])
            unit, wanted = _unit(m), min(k + 1, len(m))
            for q, vector in zip(queries["q"], queries["v"]):
                vector = np.asarray(vector, np.float64)
                product = unit @ _unit(vector[None])[0]
                near = np.flatnonzero(product >= np.partition(product, len(m) - wanted)[len(m) - wanted] - ROUNDING)
                exact = _cosines(m[near], vector)
                best = sorted((-s, i) for s, at in zip(exact.tolist(), near) for i in ids[at])
                found += [(q, i, -s) for s, i in best[: k + 1]]
        return pd.DataFrame(found, columns=["q", "vec_id", "score"])

    keys = ["tree", "leaf", "part"]
    scored = (
        probes.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(rank, "q long, vec_id long, score double")
    )
    found = scored.groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    found = written(found.join(distinct, "q").select("v", "vec_id", "score"), "found")
    mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.join(found, "v")
        .filter("vec_id != query_id")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(mine).cast("int"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
