"""Periodic node reports as an incrementally kept view.

A report is a sum over the containers of a node, and a container's row changes only when its series gets
samples, because every series runs on its own latest one. So three tables are kept beside the reports, each with
whole versions and bounded parts (:class:`~trimline.streaming.snapshots.Snapshots`):

* ``-buckets``: fine buckets, computed anew when a batch touches them, from the samples of just these buckets;
* ``-hours``: coarse buckets that lie before the live tail, merged from the fine ones once they close, and
  again when a late sample touches them;
* ``-series``: one row per series: its clock, its latest metadata and owner, and its summary.

The summary of a touched series merges its closed hours, the fine buckets of the hour in which the tail
begins and of the hour in which fine retention ends, and the samples of the tail itself. That equals a
summary over all its retained samples, which are never read again.
"""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trimline.functions.clock import MICROS, epoch_us, floor_us
from trimline.operators.buckets import COARSE, FINE, PREFIXES, assign_tier, fine_level, without_nulls
from trimline.operators.series import LATEST, fill_metadata, merge_spans, with_span
from trimline.operators.waste import container_waste, node_waste, pod_waste
from trimline.params import EXACT, Tiering
from trimline.schemas import SERIES
from trimline.streaming.writing import trigger_of, write_batch
from trimline.streaming.silver import exact_buckets, partial_buckets
from trimline.streaming.snapshots import VERSION, Snapshots, newest

_KEY = list(SERIES)
_MERGED = [f"{p}_{k}" for p in PREFIXES for k in ("wsum", "p95", "p99", "max")]
#: Batches between two compactions of the bucket and hour tables; the series table is compacted more often.
COMPACT_BUCKETS = 288


class Edges:
    """Where the parts of a series' summary meet, from its clock in ``clock_us``."""

    def __init__(self, t: Tiering, clock: Column):
        #: The tail begins with the fine bucket in which the live tier begins; its samples are read raw.
        self.tail = floor_us(clock - t.raw_seconds * MICROS, t.fine_seconds)
        #: Coarse buckets before this one are closed.
        self.closed = floor_us(self.tail, t.coarse_seconds)
        #: The coarse bucket that may hold fine buckets of both tiers.
        self.mixed = floor_us(clock - t.fine_keep_seconds * MICROS, t.coarse_seconds)
        self.oldest = clock - t.coarse_keep_seconds * MICROS


def _days(rows: DataFrame, *us: str) -> list[date]:
    """Days from ``us[0]`` to ``us[-1]`` of the rows; at most all days there are."""
    first, last = (F.to_date(F.timestamp_micros(c)) for c in (us[0], us[-1]))
    found = rows.select(F.explode(F.sequence(first, last)).alias("day")).distinct()
    return sorted(r["day"] for r in found.collect())


class ReportView:
    """The tables beside the reports at ``root``, brought up to date by one batch after the other."""

    def __init__(self, spark: SparkSession, bronze_path: str, root: str, t: Tiering):
        self.spark, self.bronze_path, self.root, self.t = spark, bronze_path, root, t
        self.buckets = Snapshots(spark, f"{root}-buckets", ["day"])
        self.hours = Snapshots(spark, f"{root}-hours", ["day"])
        self.series = Snapshots(spark, f"{root}-series")

    def _bronze(self, days: list[date]) -> DataFrame:
        return without_nulls(self.spark.read.parquet(self.bronze_path).filter(F.col("day").isin(days)))

    def _new(self, table: Snapshots, version: int) -> DataFrame:
        return table.read(version + 1).filter(F.col(VERSION) == version)

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows``, written once for all steps of a batch that read them; the next batch takes their place."""
        path = f"{self.root}-work/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def update(self, batch: DataFrame, version: int) -> DataFrame:
        """Take in a batch of samples; the current rows of all series."""
        batch = without_nulls(batch).filter("ts is not null").withColumn("ts_us", epoch_us(F.col("ts")))
        before = self.series.newest(_KEY, version)
        self._touch_buckets(batch, version)
        clocks = self._kept(self._clocks(before, version), "clocks")
        self._close_hours(clocks, version)
        metadata = self._metadata(batch, before)
        rows = clocks.drop("before_us").join(self._summary(clocks), _KEY).join(metadata, _KEY)
        self.series.merge(rows, version, _KEY)
        return self.series.newest(_KEY, version + 1)

    def _retained(self, start: str):
        """Keeps buckets of the retention of their series; used when a table is compacted."""
        series = self.series.read()
        if series is None:
            return lambda rows: rows
        edges = Edges(self.t, F.col("clock_us"))
        oldest = newest(series, _KEY).select(*_KEY, F.least(edges.oldest, edges.mixed).alias("oldest_us"))
        return lambda rows: rows.join(oldest, _KEY, "left").filter(F.col("oldest_us").isNull() | (F.col(start) >= F.col("oldest_us"))).drop("oldest_us")

    def _touch_buckets(self, batch: DataFrame, version: int) -> None:
        t = self.t
        touched = batch.withColumn("bucket_us", floor_us(F.col("ts_us"), t.fine_seconds))
        samples = self._bronze(_days(touched, "bucket_us"))
        touched = touched.select(*_KEY, "bucket_us", F.to_date(F.timestamp_micros("bucket_us")).alias("day")).distinct()
        if t.mode == EXACT:
            rows = exact_buckets(samples, touched, t)
        else:
            of_bucket = samples.withColumn("bucket_us", floor_us(epoch_us(F.col("ts")), t.fine_seconds))
            rows = partial_buckets(of_bucket.join(touched, [*_KEY, "bucket_us", "day"], "left_semi"), t)
            rows = rows.withColumns({f"{p}_{k}": F.col(f"{p}_max") for p in PREFIXES for k in ("p95", "p99")})
        columns = [*_KEY, "bucket_us", "n", *_MERGED, "first_us", "last_us", "day"]
        self.buckets.merge(rows.select(*columns), version, [*_KEY, "bucket_us"], self._retained("bucket_us"), COMPACT_BUCKETS)

    def _clocks(self, before: DataFrame | None, version: int) -> DataFrame:
        """(series, clock_us, before_us) of the touched series."""
        clocks = self._new(self.buckets, version).groupBy(*_KEY).agg(F.max("last_us").alias("new_us"))
        old = F.lit(None).cast("long")
        if before is not None:
            clocks, old = clocks.join(before.select(*_KEY, F.col("clock_us").alias("old_us")), _KEY, "left"), F.col("old_us")
        # greatest skips nulls
        return clocks.select(*_KEY, F.greatest("new_us", old).alias("clock_us"), old.alias("before_us"))

    def _close_hours(self, clocks: DataFrame, version: int) -> None:
        """Merge the hours that this batch touched or closed; those in which the tail moves stay open."""
        width = self.t.coarse_seconds
        touched = self._new(self.buckets, version).select(*_KEY, floor_us(F.col("bucket_us"), width).alias("hour_us"))
        was = Edges(self.t, F.col("before_us"))
        left_open = F.sequence(was.closed, floor_us(F.col("before_us"), width), F.lit(width * MICROS))
        opened = clocks.filter("before_us is not null").select(*_KEY, F.explode(left_open).alias("hour_us"))
        now = clocks.select(*_KEY, Edges(self.t, F.col("clock_us")).closed.alias("closed_us"))
        pairs = touched.unionByName(opened).distinct().join(now, _KEY).filter("hour_us < closed_us").drop("closed_us")
        pairs = self._kept(pairs, "hours")
        days = _days(pairs, "hour_us")

        def of_pairs(fine: DataFrame) -> DataFrame:
            fine = fine.filter(F.col("day").isin(days)).withColumn("hour_us", floor_us(F.col("bucket_us"), width))
            return fine.join(pairs, [*_KEY, "hour_us"], "left_semi")

        merged = self.buckets.newest([*_KEY, "bucket_us"], version + 1, of_pairs).groupBy(*_KEY, "hour_us", "day").agg(
            F.sum("n").alias("n"),
            *[F.sum(c).alias(c) if c.endswith("wsum") else F.max(c).alias(c) for c in _MERGED],
            F.min("bucket_us").alias("first_bucket_us"),
            F.max("bucket_us").alias("last_bucket_us"),
        )
        self.hours.merge(merged, version, [*_KEY, "hour_us"], self._retained("hour_us"), COMPACT_BUCKETS)

    def _summary(self, clocks: DataFrame) -> DataFrame:
        """Summaries of the touched series."""
        t, edges = self.t, Edges(self.t, F.col("clock_us"))
        clocks = clocks.drop("before_us").withColumns(
            {"tail_us": edges.tail, "closed_us": edges.closed, "mixed_us": edges.mixed, "oldest_us": edges.oldest}
        ).withColumn("from_us", F.least("oldest_us", "mixed_us"))
        columns = [*_KEY, "n", *_MERGED, "start_us", "end_us", "from_us", "to_us"]

        days = _days(clocks, "from_us", "clock_us")
        hours = self.hours.newest([*_KEY, "hour_us"], where=lambda rows: rows.filter(F.col("day").isin(days)))
        hours = hours.join(clocks.drop("from_us"), _KEY).filter("hour_us < closed_us and hour_us != mixed_us")
        is_fine = F.col("hour_us") > F.col("mixed_us")
        hours = hours.filter(is_fine | (F.col("hour_us") >= F.col("oldest_us")))
        start = F.when(is_fine, F.col("first_bucket_us")).otherwise(F.col("hour_us"))
        end = F.when(is_fine, F.col("last_bucket_us") + t.fine_seconds * MICROS).otherwise(F.col("hour_us") + t.coarse_seconds * MICROS)
        hours = hours.withColumns({"start_us": start, "end_us": end, "from_us": start, "to_us": end})

        days = sorted({*_days(clocks, "mixed_us"), *_days(clocks, "closed_us", "tail_us")})
        hour = floor_us(F.col("bucket_us"), t.coarse_seconds)
        edge = ((hour == F.col("mixed_us")) | (hour >= F.col("closed_us"))) & (F.col("bucket_us") < F.col("tail_us"))

        def at_edges(rows: DataFrame) -> DataFrame:
            return rows.filter(F.col("day").isin(days)).join(clocks.drop("from_us"), _KEY).filter(edge)

        fine = self.buckets.newest([*_KEY, "bucket_us"], where=at_edges)
        # a settled bucket has the tier of any sample in it; its start is one such time
        fine = assign_tier(fine.withColumn("ts_us", F.col("bucket_us")).drop("bucket_us"), t).filter(F.col("tier").isin(FINE, COARSE))

        tail = self._bronze(_days(clocks, "tail_us", "clock_us")).join(clocks.select(*_KEY, "tail_us"), _KEY)
        tail = fine_level(tail.filter(epoch_us(F.col("ts")) >= F.col("tail_us")), t)
        rows = hours.select(*columns).unionByName(with_span(fine, t).select(*columns)).unionByName(with_span(tail, t).select(*columns))
        return merge_spans(rows)

    def _metadata(self, batch: DataFrame, before: DataFrame | None) -> DataFrame:
        """Latest metadata and owner of the touched series, by (ts, seq)."""
        owner = F.when(F.col("owner_kind") != "", F.struct("ts_us", "seq", "owner_kind", "owner_name"))
        rows = batch.select(*_KEY, F.struct("ts_us", "seq", *LATEST).alias("latest"), owner.alias("owner"))
        if before is not None:
            rows = rows.unionByName(before.join(batch.select(*_KEY).distinct(), _KEY, "left_semi").select(*_KEY, "latest", "owner"))
        return rows.groupBy(*_KEY).agg(F.max("latest").alias("latest"), F.max("owner").alias("owner"))


def snapshots_of(series: DataFrame) -> DataFrame:
    """Summary and metadata of the rows of a ``-series`` table."""
    latest = [F.col(f"latest.{c}").alias(c) for c in LATEST]
    owner = [F.col(f"owner.{c}").alias(c) for c in ("owner_kind", "owner_name")]
    rest = [c for c in series.columns if c not in ("latest", "owner", "clock_us", VERSION)]
    return fill_metadata(series.select(*rest, *latest, *owner))


def start_reports(
    spark: SparkSession,
    bronze_path: str,
    reports_path: str,
    checkpoint: str,
    t: Tiering,
    interval_ms: int | None = 300_000,
) -> StreamingQuery:
    """Every interval with new samples, report all nodes that sent some.

    Node totals go to ``reports_path`` and their pods to ``<reports_path>-pods``, both as ``batch_id``
    partitions with ``seq``; the newest ``seq`` of a node is its report, and its pods are those of that
    ``seq``. The tables of :class:`ReportView` lie beside them.
    """
    if t.as_of is not None:
        raise ValueError("periodic reports run on the clocks of the series")
    schema = spark.read.parquet(bronze_path).schema
    stream = spark.readStream.schema(schema).parquet(bronze_path)
    root = reports_path.rstrip("/")
    kept = ReportView(spark, bronze_path, root, t)

    def report(batch: DataFrame, batch_id: int) -> None:
        if not batch.limit(1).count():
            return
        series = kept.update(batch, batch_id)
        nodes = batch.select(F.coalesce("node_name", F.lit("")).alias("node_name")).distinct()
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        stamp = F.lit(now.isoformat(sep=" ")).cast("timestamp")
        added = {"report_time": stamp, "seq": F.lit(batch_id).cast("bigint")}
        found = snapshots_of(series.join(nodes, "node_name", "left_semi"))
        pods = pod_waste(container_waste(found)).withColumns(added)
        write_batch(pods, f"{root}-pods", batch_id, partitions=())
        written = spark.read.schema(pods.schema).parquet(f"{root}-pods/batch_id={batch_id}")
        write_batch(node_waste(written).withColumns(added), root, batch_id, partitions=())

    return (
        stream.writeStream.foreachBatch(report)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_of(interval_ms))
        .start()
    )
