"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

Texts are equal when they are identical after every run of ASCII white space is one space; a null
text is the empty text. A frequent-items sketch (Misra-Gries counters with batched decrements) finds
digests that may be frequent. Their groups are counted exactly, with partial sums before the shuffle,
and the at most ``heavy`` winners are broadcast: rows of frequent digests never meet in one task.
All other digests are grouped by an ordinary shuffle; the sketch's error bound keeps each of those
groups below about ``4 / tracked`` of all rows.

Defined results: a null id comes after all other ids; rows that repeat an id are separate rows, of
which one stays; an empty table gives an empty table; other columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trimline.llm.tables import fresh
from trimline.scratch import written

#: Counters of a sketch, digests taken from all sketches, and sketches that share the digests.
TRACKED, HEAVY, SKETCHES = 4096, 1000, 64


def normalised(text: Column) -> Column:
    """Every run of ASCII white space as one space; null as empty. Single spaces stay untouched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _winners(rows: DataFrame, tracked: int, heavy: int) -> DataFrame:
    """(digest, keep_id, group_size) of at most ``heavy`` candidates, counted exactly."""
    # digests are spread over the sketches, so all copies of one meet the same counters
    sketches = rows.groupBy(F.pmod(F.col("digest_hash"), F.lit(SKETCHES)).alias("part"))
    candidates = (
        sketches.agg(F.expr(f"approx_top_k(digest_hash, {heavy}, {tracked})").alias("top"))
        .select(F.explode("top").alias("c"))
        .filter("c.count > 1")
        .orderBy(F.desc("c.count"), "c.item")
        .limit(heavy)
        .select(F.col("c.item").alias("digest_hash"))
    )
    found = rows.join(F.broadcast(candidates), "digest_hash", "left_semi")
    return written(
        found.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")), "heavy"
    )


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    digest = F.sha2(normalised(F.col(f"`{text_col}`")), 256)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), digest.alias("digest"))
    return rows.withColumn("digest_hash", F.xxhash64("digest"))


def decisions(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED, heavy: int = HEAVY
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = written(_digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "digests")
    winners = _winners(rows, tracked, heavy)
    # of rows that repeat the winning id, the first one stays
    first = (
        rows.join(F.broadcast(winners.select("digest", "keep_id")), "digest")
        .filter(F.col("id").eqNullSafe(F.col("keep_id")))
        .groupBy("digest")
        .agg(F.min("row").alias("keep_row"))
    )
    settled = written(winners.join(F.broadcast(first), "digest"), "winners")
    frequent = rows.join(F.broadcast(settled), "digest").withColumn("kept", F.col("row") == F.col("keep_row"))
    group = Window.partitionBy("digest")
    order = group.orderBy(F.col("id").asc_nulls_last(), "row")
    ordinary = (
        rows.join(F.broadcast(settled.select("digest")), "digest", "left_anti")
        .withColumn("keep_id", F.min("id").over(group))
        .withColumn("group_size", F.count("*").over(group))
        .withColumn("kept", F.row_number().over(order) == 1)
    )
    columns = [
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.col("digest").alias("text_sha256"),
    ]
    return frequent.select(*columns).unionByName(ordinary.select(*columns))


def without_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED, heavy: int = HEAVY
) -> DataFrame:
    """The rows that stay, with all their columns: one for each text, the one with the smallest id.

    Copies of frequent texts are removed where they are read, the rest after a shuffle by digest.
    """
    rows = written(_digests(docs, id_col, text_col), "digests")
    digest, keep, rank = (fresh(docs, name) for name in ("digest_of_text", "id_to_keep", "place"))
    winners = _winners(rows, tracked, heavy).select(F.col("digest").alias(digest), F.col("keep_id").alias(keep))
    ids = F.col(f"`{id_col}`").cast("long")
    marked = docs.withColumn(digest, F.sha2(normalised(F.col(f"`{text_col}`")), 256))
    left = marked.join(F.broadcast(winners), digest, "left").filter(F.col(keep).isNull() | ids.eqNullSafe(F.col(keep)))
    order = Window.partitionBy(digest).orderBy(ids.asc_nulls_last())
    one = left.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1)
    return one.select(*[F.col(f"`{c}`") for c in docs.columns])
