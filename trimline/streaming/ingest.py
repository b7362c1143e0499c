"""Continuous ingest of landed usage documents into the bronze table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trimline.operators.enrich import enrich_samples, last_spec
from trimline.operators.series import fill_metadata
from trimline.schemas import METADATA_DEFAULTS
from trimline.sources.kubelet import (
    CORRUPT,
    pod_specs,
    read_documents,
    read_pod_documents,
    readable,
    rejected,
    usage_samples,
)
from trimline.streaming.specs import SpecHistory, enrich_valid
from trimline.streaming.writing import MIN_INTERVAL_MS, trigger_of, write_batch

__all__ = ["MIN_INTERVAL_MS", "enrich_batch", "start_ingest", "trigger_of", "write_batch"]

def enrich_batch(samples: DataFrame, specs_path: str | None) -> DataFrame:
    """Join a batch to the specs as they are now; without specs, or before any, samples keep zeros."""
    specs = None
    if specs_path is not None:
        try:
            specs = pod_specs(readable(read_pod_documents(samples.sparkSession, specs_path)))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    if specs is None:
        return fill_metadata(
            samples.withColumns({c: F.lit(None) for c in METADATA_DEFAULTS})
        )
    return enrich_samples(samples, last_spec(specs, ["scraped_at", "seq"]))


def start_ingest(
    spark: SparkSession,
    usage_path: str,
    specs_path: str | None,
    bronze_path: str,
    checkpoint: str,
    interval_ms: int | None = 30_000,
    spec_table: str | None = None,
    rejects_path: str | None = None,
) -> StreamingQuery:
    """Flatten new usage documents, join specs and append to bronze.

    With ``spec_table`` (kept by :func:`~trimline.streaming.specs.start_specs`) a sample takes the spec that was
    valid at its time; with ``specs_path``, a folder of pod documents, the last spec landed so far. Documents that
    cannot be read are kept at ``rejects_path``; ``<rejects_path>-counts`` has a row of counts for every batch.
    """
    documents = read_documents(spark, usage_path, streaming=True)

    def append(batch: DataFrame, batch_id: int) -> None:
        samples = usage_samples(readable(batch))
        if spec_table is None:
            enriched = enrich_batch(samples, specs_path)
        else:
            history = SpecHistory(spark, spec_table).read()
            enriched = enrich_batch(samples, None) if history is None else enrich_valid(samples, history)
        write_batch(enriched.withColumn("day", F.to_date("ts")), bronze_path, batch_id)
        if rejects_path is not None:
            seen = Observation("documents")
            bad = F.count_if(F.col(CORRUPT).isNotNull()).alias("rejected")
            counted = batch.observe(seen, F.count(F.lit(1)).alias("landed"), bad)
            write_batch(rejected(counted).withColumn("day", F.to_date("scraped_at")), rejects_path, batch_id)
            counts = spark.createDataFrame([(seen.get["landed"], seen.get["rejected"])], "landed bigint, rejected bigint")
            write_batch(counts, f"{rejects_path.rstrip('/')}-counts", batch_id, partitions=())

    return (
        documents.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_of(interval_ms))
        .start()
    )
