"""Exact top-k search by integer inner product: distributed histogram selection.

Queries and candidates are packed in blocks of bounded size, and every pair of blocks is a cell. In each
round all cells are scored with one matrix product, the scores of a query are counted by their next
``DIGIT`` bits, and the counts of all cells are added up: they show in which bin the k-th largest score lies.
The next round counts within that bin only. A query is settled once no more than ``SPARE`` scores beyond the
``k`` wanted lie in or above its bin, or once the bin is one value. A last pass lets through the scores at or
above the bin's lower end, each cell at most the ``k`` best of them, and ties are broken by the smaller id.

A cell names the bins from its largest score down to its own k-th largest only, since no lower bin can hold
the k-th largest of all: what is shuffled grows with ``k``, not with the scores. Products are exact: in doubles
where the norms rule out a sum of 2^53 or more, in whole numbers of any size otherwise.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows
without an id; a vector is compared with those of its own length (the empty ones have product 0); rows that
repeat are separate rows, and a query passes over its own row only; a product beyond 64 bits counts as the
nearest long; queries with fewer than ``k`` others get all; an empty table gives an empty table; other
columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trimline.llm.batches import bound_batches
from trimline.scratch import written

SCALE = 256
#: Bits of a score that one round tells apart.
DIGIT = 12
#: Numbers in a block of candidates, and in a block of queries.
CANDIDATE_VALUES, QUERY_VALUES = 1 << 19, 1 << 17
#: Candidates in a block at least, where there are too few blocks for all cores.
LEAST_ROWS = 256
#: Scores beyond those wanted that the last pass may let through.
SPARE = 64
#: Scores worked on at a time.
SCORES = 1 << 20

_BLOCK = "dim int, part long, rows binary, ids binary, matrix binary, norm double"


def _valid(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str) -> DataFrame:
    kind = vectors.schema[vector_col].dataType.elementType
    number = "float" if isinstance(kind, T.FloatType) else "double"
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(is_query, F.lit(False)).alias("asked"),
        F.col(f"`{vector_col}`").cast(f"array<{number}>").alias("v"),
    )
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)
    return rows.withColumns({"dim": F.size("v"), "row": F.monotonically_increasing_id()})


def _whole(m: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(m.astype(np.float64) * scale)


def _packed(rows: DataFrame, parts: int, number: str, scale: int) -> DataFrame:
    """Blocks of about equal size; rows are spread by their number, so copies and hot ids spread too."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        m = np.stack(pdf["v"].to_numpy()).astype(number) if pdf["dim"].iat[0] else np.zeros((len(pdf), 0), number)
        with np.errstate(over="ignore"):
            norm = float(np.sqrt((_whole(m, scale) ** 2).sum(axis=1)).max())
        row = pdf["row"].to_numpy(np.int64).tobytes(), pdf["id"].to_numpy(np.int64).tobytes(), m.tobytes()
        return pd.DataFrame([(pdf["dim"].iat[0], pdf["part"].iat[0], *row, norm)], columns=["dim", "part", "rows", "ids", "matrix", "norm"])

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    return dealt.select("dim", "part", "row", "id", "v").groupBy("dim", "part").applyInPandas(pack, _BLOCK)


def _exact(m: np.ndarray, scale: int) -> np.ndarray:
    """Whole numbers of any size; a double of 2^52 or more is a whole number."""
    out = np.empty(m.shape, object)
    for at, x in np.ndenumerate(m.astype(np.float64)):
        out[at] = math.floor(x * scale) if abs(x) < 2.0**52 else int(x) * scale
    return out


def _products(queries: np.ndarray, candidates: np.ndarray, scale: int, bound: float) -> np.ndarray:
    if bound < 2.0**53:  # no partial sum of the product can be rounded
        return (_whole(queries, scale) @ _whole(candidates, scale).T).astype(np.int64)
    limits = np.iinfo(np.int64)
    exact = np.dot(_exact(queries, scale), _exact(candidates, scale).T)
    return np.array([[min(max(x, limits.min), limits.max) for x in line] for line in exact], np.int64).reshape(len(queries), len(candidates))


class _Cells:
    """The scores of joined block pairs, a few queries at a time."""

    def __init__(self, number: str, scale: int, bits: int):
        self.number, self.scale, self.offset = number, scale, np.uint64(1 << (bits - 1))

    def __call__(self, batch: pd.DataFrame, live: bool) -> Iterator[tuple]:
        """(query rows, state of each, candidate ids and rows, shifted scores, mask of pairs of different rows)."""
        for cell in batch.itertuples():
            q_rows, c_rows = np.frombuffer(cell.q_rows, np.int64), np.frombuffer(cell.rows, np.int64)
            asked = np.frombuffer(cell.q_matrix, self.number).reshape(len(q_rows), cell.dim)
            given = np.frombuffer(cell.matrix, self.number).reshape(len(c_rows), cell.dim)
            at = np.searchsorted(q_rows, np.asarray(cell.s_row, np.int64))
            keep = np.flatnonzero(~np.asarray(cell.s_settled, bool)) if live else np.arange(len(at))
            step = max(1, min(256, SCORES // max(1, len(c_rows))))
            for lo in range(0, len(keep), step):
                some = keep[lo : lo + step]
                scores = _products(asked[at[some]], given, self.scale, cell.q_norm * cell.norm)
                shifted = scores.view(np.uint64) + self.offset
                other = q_rows[at[some]][:, None] != c_rows[None, :]
                state = {name: np.asarray(getattr(cell, f"s_{name}"))[some] for name in ("prefix", "above")}
                yield q_rows[at[some]], state, np.frombuffer(cell.ids, np.int64), c_rows, shifted, other


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    candidate_values: int = CANDIDATE_VALUES,
    query_values: int = QUERY_VALUES,
    spare: int = SPARE,
) -> DataFrame:
    """The ``k`` other rows of largest inner product of each query row: query_id, rank, vec_id, score.

    ``is_query`` is a condition on the input's columns; components count as floor(scale * x).
    """
    spark = vectors.sparkSession
    rows = written(_valid(vectors, is_query, id_col, vector_col), "vectors")
    number = "<f4" if rows.schema["v"].dataType.elementType == T.FloatType() else "<f8"
    total, asked_total, longest = rows.agg(F.count("*"), F.count_if("asked"), F.max("dim")).first()
    if not asked_total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    longest = max(1, longest)
    cores = spark.sparkContext.defaultParallelism
    spread = min(2 * cores, -(-total // LEAST_ROWS))
    columns = max(1, spread, -(-total * longest // candidate_values))
    lines = max(1, -(-asked_total * longest // query_values))
    cells = min(1 << 14, lines * columns)
    blocks = written(_packed(rows, columns, number, scale), "candidate-blocks")
    asked = _packed(rows.filter("asked"), lines, number, scale)
    asked = written(asked.select("dim", F.col("part").alias("line"), F.col("rows").alias("q_rows"), F.col("matrix").alias("q_matrix"), F.col("norm").alias("q_norm")), "query-blocks")
    largest = blocks.agg(F.max("norm")).first()[0] * asked.agg(F.max("q_norm")).first()[0]
    bits = 64 if not largest < 2.0**61 else max(2, int(largest * 1.001 + 1).bit_length() + 1)
    scored = _Cells(number, scale, bits)
    given = blocks.withColumnRenamed("part", "column").withColumn("line", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lines - 1).cast("long"))))

    def joined(state: DataFrame) -> DataFrame:
        """Cells with the states of their queries: one row per pair of blocks, joined by the cell's number."""
        ordered = F.sort_array(F.collect_list(F.struct("row", "prefix", "above", "settled")))
        by_line = state.groupBy("dim", "line").agg(ordered.alias("s"))
        by_line = by_line.select("dim", "line", *[F.col(f"s.{c}").alias(f"s_{c}") for c in ("row", "prefix", "above", "settled")])
        left = asked.join(by_line, ["dim", "line"]).withColumn("column", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))))
        key = ["dim", "line", "column"]
        return bound_batches(left.repartition(cells, *key).join(given.repartition(cells, *key), key))

    def counted(shift: int, before: int | None):
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for q_rows, state, _, _, shifted, other in scored(batch, live=True):
                    if before is not None:
                        other &= (shifted >> np.uint64(before)) == state["prefix"].astype(np.int64).view(np.uint64)[:, None]
                    size = 1 << ((bits if before is None else before) - shift)
                    digit = ((shifted >> np.uint64(shift)) & np.uint64(size - 1)).astype(np.int64)
                    flat = (np.arange(len(q_rows))[:, None] * size + digit)[other]
                    bins = np.bincount(flat, minlength=len(q_rows) * size).reshape(-1, size)[:, ::-1]
                    higher = bins.cumsum(axis=1) - bins
                    which, place = np.nonzero((bins > 0) & (higher < (k - state["above"].astype(np.int64))[:, None]))
                    yield pd.DataFrame({"row": q_rows[which], "digit": size - 1 - place, "n": bins[which, place]})

        return count

    def passed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q_rows, state, ids, _, shifted, other in scored(batch, live=False):
                which, place = np.nonzero((shifted >= state["prefix"].astype(np.int64).view(np.uint64)[:, None]) & other)
                value, named = shifted[which, place], ids[place]
                order = np.lexsort((named, np.iinfo(np.uint64).max - value, which))
                which, value, named = which[order], value[order], named[order]
                first = np.searchsorted(which, which)
                best = np.arange(len(which)) - first < k
                yield pd.DataFrame({"row": q_rows[which[best]], "vec_id": named[best], "score": (value[best] - scored.offset).view(np.int64)})

    # until a query is settled, prefix holds the bits fixed so far; afterwards the least score to let through
    names = rows.filter("asked").select("row", F.col("id").alias("query_id"), "dim", F.pmod(F.xxhash64("row"), F.lit(lines)).alias("line"))
    start = {"prefix": F.lit(0).cast("long"), "above": F.lit(0).cast("long"), "settled": F.lit(False)}
    state = written(names.drop("query_id").withColumns(start), "states")
    before, shift = None, max(0, bits - DIGIT)
    while True:
        found = joined(state).mapInPandas(counted(shift, before), "row long, digit long, n long")
        found = found.groupBy("row", "digit").agg(F.sum("n").alias("n"))
        downwards = Window.partitionBy("row").orderBy(F.desc("digit"))
        # a bin above the k-th score is named by every cell that holds some of it, so these counts are whole
        reached = found.withColumn("upto", F.sum("n").over(downwards)).join(state, "row")
        reached = reached.withColumns({"higher": F.col("above") + F.col("upto") - F.col("n"), "upto": F.col("above") + F.col("upto")})
        digits = (bits if before is None else before) - shift
        bin_ = F.shiftleft("prefix", digits).bitwiseOR(F.col("digit"))
        done = (F.col("upto") <= k + spare) | F.lit(shift == 0)
        chosen = reached.filter((F.col("higher") < k) & (F.col("upto") >= k)).select(
            "row",
            F.when(done, F.shiftleft(bin_, shift)).otherwise(bin_).alias("new_prefix"),
            F.col("higher").alias("new_above"),
            done.alias("new_settled"),
        )
        # fewer than k others: all of them pass
        state = state.join(chosen, "row", "left").select(
            "row",
            "dim",
            "line",
            F.when(F.col("settled"), F.col("prefix")).otherwise(F.coalesce("new_prefix", F.lit(0).cast("long"))).alias("prefix"),
            F.coalesce("new_above", "above").alias("above"),
            (F.col("settled") | F.coalesce("new_settled", F.lit(True))).alias("settled"),
        )
        state = written(state, "states")
        if shift == 0 or not state.filter(~F.col("settled")).limit(1).count():
            break
        before, shift = shift, max(0, shift - DIGIT)

    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = joined(state).mapInPandas(passed, "row long, vec_id long, score long").withColumn("rank", F.row_number().over(best).cast("int"))
    return ranked.filter(F.col("rank") <= k).join(names.select("row", "query_id"), "row").select("query_id", "rank", "vec_id", "score")
