"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of ``block_rows`` rows. With weight ``w`` its block ``i`` is released at
``floor(i / w)`` and due at ``ceil((i + 1) / w)``; in every slot the released block with the earliest
deadline runs. As long as all sources have blocks, the blocks of a source differ from its weight's share
by less than one, after every slot.

Weights are exact fractions, never rounded: releases and deadlines of every block come from them, for as long
as the table lasts and however many sources there are. The schedule needs only the blocks of each source and
is made by one task that carries its state (the next block of each source) and writes the slots in batches:
work is linear in the blocks and memory in the sources. Rows get their place in their source by ordering
ranges of (source, hash of the id) and adding up the counts of the ranges before; a source may fill any part
of the table. A caller who wants a schedule that repeats names a ``cycle``: weights are then rounded to whole
shares of so many slots, and the bound above holds for these shares.

A source that has run out leaves its slots empty and the others keep their order; no row is dropped.

Defined results: a null source is a source of its own; sources without a weight are an error, weights of
absent sources leave empty slots; ties between deadlines go to the source that sorts first (null first);
rows that repeat are separate rows; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trimline.scratch import written

BLOCK_ROWS = 16
#: Slots of a cycle, where the caller wants one. At least the number of sources.
CYCLE = 1_000
#: Slots that the scheduling task writes at a time.
BATCH = 1 << 16
#: Sources that one mix may have.
MOST_SOURCES = 100_000
#: Exponent of the sources' sizes in their default weights: large sources lose, small ones win.
TEMPERATURE = 0.5


def _checked(weights: dict[str | None, float]) -> None:
    if any(not 0 < w < float("inf") for w in weights.values()):
        raise ValueError("weights must be positive")
    if len(weights) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")


def whole(weights: dict[str | None, float]) -> dict[str | None, int]:
    """Whole numbers in exactly the proportions of the weights."""
    _checked(weights)
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


def slots(parts: dict[str | None, int], blocks: dict[str | None, int]) -> Iterator[tuple[str | None, int, int]]:
    """(source, block, slot) of all blocks, by slot: earliest deadline first among released blocks.

    A source's share of the slots is its part of the sum of all parts.
    """
    total = sum(parts.values())
    waiting = [(0, -(-total // parts[s]), s is not None, s or "", 0) for s, n in blocks.items() if n]
    heapq.heapify(waiting)
    ready: list[tuple[int, bool, str, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])  # slots of sources that have run out stay empty
        while waiting and waiting[0][0] <= slot:
            _, deadline, named, name, block = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, named, name, block))
        deadline, named, name, block = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a block missed its deadline")
        source = name if named else None
        yield source, block, slot
        slot, following = slot + 1, block + 1
        if following < blocks[source]:
            n = parts[source]
            heapq.heappush(waiting, (following * total // n, -(-(following + 1) * total // n), named, name, following))


def repeated(share: dict[str | None, int], blocks: dict[str | None, int]) -> Iterator[tuple[str | None, int, int]]:
    """(source, block, slot) of all blocks, by the schedule of one cycle."""
    length = sum(share.values())
    for source, block, slot in schedule(share):
        for turn, at in enumerate(range(block, blocks.get(source, 0), share[source])):
            yield source, at, turn * length + slot


def shares(weights: dict[str | None, float], cycle: int = CYCLE) -> dict[str | None, int]:
    """Weights as whole shares of a cycle, at least 1 each, by largest remainders."""
    if not weights:
        return {}
    _checked(weights)
    cycle = max(cycle, len(weights))
    exact = {s: Fraction(w) for s, w in weights.items()}
    total = sum(exact.values())
    free = cycle - len(exact)
    parts = {s: w / total * free for s, w in exact.items()}
    out = {s: 1 + int(p) for s, p in parts.items()}
    rest = sorted(parts, key=lambda s: (int(parts[s]) - parts[s], s is not None, s or ""))
    for s in rest[: cycle - sum(out.values())]:
        out[s] += 1
    return out


def schedule(share: dict[str | None, int]) -> list[tuple[str | None, int, int]]:
    """(source, block, slot) of one cycle: earliest deadline first among released blocks."""
    cycle = sum(share.values())
    waiting = [(0, -(-cycle // n), s is not None, s or "", 0) for s, n in share.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, bool, str, int]] = []
    out = []
    for slot in range(cycle):
        while waiting and waiting[0][0] <= slot:
            _, deadline, named, name, block = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, named, name, block))
        deadline, named, name, block = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a block missed its deadline")
        source = name if named else None
        out.append((source, block, slot))
        n, following = share[source], block + 1
        if following < n:
            heapq.heappush(
                waiting, (following * cycle // n, -(-(following + 1) * cycle // n), named, name, following)
            )
    return out


def tempered(docs: DataFrame, source_col: str = "source", temperature: float = TEMPERATURE) -> dict[str | None, float]:
    """Weights by the sources' sizes to a power; one row per source comes to the driver."""
    counts = docs.groupBy(F.col(f"`{source_col}`").cast("string").alias("s")).count().limit(MOST_SOURCES + 1)
    return {r["s"]: float(r["count"]) ** temperature for r in counts.collect()}


def mix(
    docs: DataFrame,
    weights: dict[str | None, float],
    id_col: str = "doc_id",
    source_col: str = "source",
    block_rows: int = BLOCK_ROWS,
    cycle: int | None = None,
) -> DataFrame:
    """All rows with ``block``, ``slot`` and ``place`` (order within the slot); columns of these names are replaced."""
    spark = docs.sparkSession
    parts = whole(weights) if cycle is None else shares(weights, cycle)
    source = F.col(f"`{source_col}`").cast("string")
    kept = [c for c in docs.columns if c.lower() not in ("block", "slot", "place")]
    # the caller's columns go by number here, so that none has the name of a helper column
    ids = F.col(f"`{id_col}`")
    named = docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], source.alias("__s"), F.xxhash64(ids).alias("__h"), ids.alias("__id")
    )
    ranges = named.repartitionByRange("__s", "__h", "__id").sortWithinPartitions("__s", "__h", "__id").drop("__h", "__id")
    # written once: row numbers within a range must not change between the two uses
    numbered = written(ranges.withColumn("__n", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__n", 33)
    # one row per range and source in it: at most the ranges and the sources together
    sizes = numbered.groupBy("__s", part.alias("__p")).agg(F.min("__n").alias("__low"), F.count("*").alias("__k"))
    before = Window.partitionBy("__s").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__before", F.coalesce(F.sum("__k").over(before), F.lit(0)))
    starts = written(starts, "range-starts")

    # one row per source; with more sources than weights may be, one has no weight
    counts = starts.groupBy("__s").agg(F.sum("__k").alias("__k")).limit(MOST_SOURCES + 1).collect()
    unknown = [r["__s"] for r in counts if r["__s"] not in parts]
    if unknown:
        raise ValueError(f"sources without a weight: {unknown[:5]}")
    blocks = {r["__s"]: -(-r["__k"] // block_rows) for r in counts}

    def scheduled(one: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in one:
            found = slots(parts, blocks) if cycle is None else repeated(parts, blocks)
            while batch := list(itertools.islice(found, BATCH)):
                yield pd.DataFrame(batch, columns=["__s", "block", "slot"])

    plan = spark.range(0, 1, 1, 1).mapInPandas(scheduled, "__s string, block long, slot long")
    plan = written(plan, "slots")

    rows = _null_safe(numbered.withColumn("__p", part), F.broadcast(starts.drop("__k")), ["__s", "__p"])
    rank = F.col("__before") + F.col("__n") - F.col("__low")
    rows = rows.withColumn("__rank", rank).withColumn("block", F.floor(F.col("__rank") / block_rows).cast("long"))
    rows = _null_safe(rows, plan, ["__s", "block"]).withColumn("place", (F.col("__rank") % block_rows).cast("int"))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "block", "slot", "place")


def _null_safe(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null keys match null."""
    for k in keys:
        other = other.withColumnRenamed(k, f"{k}_r")
    on = [rows[k].eqNullSafe(other[f"{k}_r"]) for k in keys]
    return rows.join(other, on).drop(*[f"{k}_r" for k in keys])


def in_order(docs: DataFrame, weights: dict[str | None, float], **options) -> DataFrame:
    """The same rows and columns in the order of the schedule: a file written from it is the mixture."""
    mixed = mix(docs, weights, **options)
    ordered = mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")
    return ordered.select(*[F.col(f"`{c}`") for c in docs.columns])
