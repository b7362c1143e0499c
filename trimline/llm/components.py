"""Connected components of links between ids, by hooking and contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trimline.scratch import written


def _some(rows: DataFrame) -> bool:
    return bool(rows.limit(1).count())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every id that has a link to another: ``root`` is the smallest id it reaches.

    In each round a node hooks on to its smallest neighbour, chains are shortened by pointer jumping, and
    links are redrawn between roots. Every round at least halves the roots that still have links.
    A hub is no hot spot: minima are taken before the shuffle, and joins are split where they are skewed.
    """
    first, second = F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
    edges = written(links.filter(F.col(a) != F.col(b)).select(first, second).distinct(), "links")
    rounds: list[DataFrame] = []
    while _some(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy("a").agg(F.min("b").alias("m"))
        parent = written(hooked.select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "parents")
        while True:
            upper = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = parent.join(upper, "root").select("node", F.col("next").alias("root"), F.col("next") != F.col("root"))
            jumped = written(jumped.toDF("node", "root", "moved"), "parents")
            moved = _some(jumped.filter("moved"))
            parent = jumped.drop("moved")
            if not moved:
                break
        rounds.append(parent)
        left = parent.select(F.col("node").alias("a"), F.col("root").alias("x"))
        right = parent.select(F.col("node").alias("b"), F.col("root").alias("y"))
        redrawn = edges.join(left, "a").join(right, "b").filter("x != y")
        edges = written(redrawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds[0]
    for later in rounds[1:]:
        up = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        roots = roots.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return roots
