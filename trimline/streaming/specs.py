"""Pod specs as a table of validity intervals, kept by micro-batches.

Every landed pod list says what its containers asked for at the time of the scrape: a point. A point that differs
from the one before it starts an interval, valid until the next such point. A batch replaces the points of the
containers it names, lists that arrive late included, and leaves the others alone. Points between two equal ones
are kept for ``late_seconds`` only, so lists up to that late are put in their place exactly (a later one is taken to hold
until the next point that is left), and an unchanged container costs as many points as fit in that time. The table
has whole versions and is compacted (:class:`~trimline.streaming.snapshots.Snapshots`), so samples are joined to
current intervals instead of to all lists that ever landed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trimline.operators.series import fill_metadata
from trimline.schemas import METADATA_DEFAULTS, POD_LIST_DOCUMENT, SPEC_KEY
from trimline.sources.kubelet import pod_specs, read_documents, readable
from trimline.streaming.writing import trigger_of
from trimline.streaming.snapshots import COMPACT_EVERY, VERSION, Snapshots, newest

_KEY = list(SPEC_KEY)
_FIELDS = list(METADATA_DEFAULTS)
#: How late a pod list may be and still be put in its place exactly.
LATE_SECONDS = 3600


def with_intervals(points: DataFrame, late_seconds: int) -> DataFrame:
    """Points that are needed, with ``starts`` and, for those that start an interval, its end ``valid_to``.

    ``points`` has the key, ``at``, ``seq`` and the fields; of points at one time the largest ``seq`` counts,
    and of equal ones of these the largest spec.
    """
    spec = F.struct(*_FIELDS)
    known = points.groupBy(*_KEY, "at", "seq").agg(F.max(spec).alias("spec"))
    known = newest(known, [*_KEY, "at"], ["seq"])
    along = Window.partitionBy(*_KEY).orderBy("at")
    horizon = F.max("at").over(Window.partitionBy(*_KEY)) - F.expr(f"INTERVAL {late_seconds} SECONDS")
    marked = known.withColumns(
        {
            "starts": ~F.col("spec").eqNullSafe(F.lag("spec").over(along)),
            "ends": ~F.col("spec").eqNullSafe(F.lead("spec").over(along)),
            "recent": F.col("at") >= horizon,
        }
    )
    needed = marked.filter("starts or ends or recent")
    following = F.min(F.when(F.col("starts"), F.col("at"))).over(along.rowsBetween(1, Window.unboundedFollowing))
    return needed.withColumn("valid_to", F.when(F.col("starts"), following)).select(*_KEY, "at", "seq", "starts", "valid_to", "spec.*")


class SpecHistory:
    """The table of points and intervals at ``path``."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        keep_seconds: int | None = None,
        late_seconds: int = LATE_SECONDS,
        compact_every: int = COMPACT_EVERY,
    ):
        self.table, self.keep_seconds = Snapshots(spark, path), keep_seconds
        self.late_seconds, self.compact_every = late_seconds, compact_every

    def update(self, specs: DataFrame, version: int) -> None:
        """Take in parsed specs with ``scraped_at`` and ``seq``."""
        points = specs.select(*_KEY, F.col("scraped_at").alias("at"), "seq", *_FIELDS)
        before = self.table.read(version)
        if before is not None:
            touched = newest(before, _KEY).join(specs.select(*_KEY).distinct(), _KEY, "left_semi")
            points = points.unionByName(touched.select(points.columns))
        self.table.merge(with_intervals(points, self.late_seconds), version, _KEY, self._retained, self.compact_every)

    def _retained(self, rows: DataFrame) -> DataFrame:
        if self.keep_seconds is None:
            return rows
        oldest = F.lit(rows.agg(F.max("at")).first()[0]) - F.expr(f"INTERVAL {self.keep_seconds} SECONDS")
        # an interval that has not ended by then, and points of the time since
        return rows.filter((F.col("at") >= oldest) | (F.col("starts") & (F.col("valid_to").isNull() | (F.col("valid_to") >= oldest))))

    def read(self) -> DataFrame | None:
        """Intervals valid_from to valid_to with their specs; None before the first batch."""
        rows = self.table.read()
        if rows is None:
            return None
        return newest(rows, _KEY).filter("starts").withColumnRenamed("at", "valid_from").drop(VERSION, "seq", "starts")


def enrich_valid(samples: DataFrame, history: DataFrame) -> DataFrame:
    """Samples with the spec that was valid at their time.

    A sample older than all of its container's specs takes the first one, as a scrape of usage may be a
    moment ahead of the scrape of pods; containers without a spec get zeros and ''.
    """
    named = [F.col(k).alias(f"_{k}") for k in _KEY]
    begins = Window.partitionBy(*_KEY)
    known = history.withColumn("_first", F.col("valid_from") == F.min("valid_from").over(begins))
    known = known.select(*named, "valid_from", "valid_to", "_first", *_FIELDS)
    same = [F.col(k) == F.col(f"_{k}") for k in _KEY]
    started = F.col("_first") | (F.col("ts") >= F.col("valid_from"))
    ended = F.col("valid_to").isNotNull() & (F.col("ts") >= F.col("valid_to"))
    joined = samples.join(known, [*same, started & ~ended], "left")
    return fill_metadata(joined.select(*samples.columns, *_FIELDS))


def start_specs(
    spark: SparkSession,
    pods_path: str,
    table_path: str,
    checkpoint: str,
    interval_ms: int | None = 30_000,
    keep_seconds: int | None = None,
    late_seconds: int = LATE_SECONDS,
) -> StreamingQuery:
    """Follow landed pod documents and keep the table of their intervals at ``table_path``."""
    specs = pod_specs(readable(read_documents(spark, pods_path, POD_LIST_DOCUMENT, streaming=True)))
    history = SpecHistory(spark, table_path, keep_seconds, late_seconds)

    def take_in(batch: DataFrame, batch_id: int) -> None:
        history.update(batch, batch_id)

    return (
        specs.writeStream.foreachBatch(take_in)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_of(interval_ms))
        .start()
    )
