"""Tables written half-way through an operator, in the folder that all executors share.

The folder is ``spark.checkpoint.dir`` of the session. Only a session in local mode may run without
that setting: it then gets a temporary folder of its own.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder of a session; an error on a cluster that names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="trimline-")
    return _LOCAL[app]


def place(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: lineage ends here, and a lost executor costs no rework.

    The table stays until :func:`clear`, because the caller's result is lazy.
    """
    spark = df.sparkSession
    path = place(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table that :func:`written` returned, once nothing that is still to run reads it."""
    _delete(table.sparkSession, table.scratch_path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished stages: it does so when their plans are collected."""
    gc.collect()
    spark._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Delete what this session wrote, once no result that reads it is needed."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
