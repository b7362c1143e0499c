"""A table whose readers see one whole version at a time: Parquet parts and manifests that name them.

A version is a list of parts (folders of Parquet files). A writer puts new rows in a part of its own and then
publishes a manifest that lists the parts that count from now on; the manifest appears by one rename, so a
reader has the version before or the version after, never a mixture. Rows carry the number of the version
that wrote them, and of rows that share a key the newest counts (:func:`newest`). Every ``compact_every``
versions a writer publishes one part with the newest rows only, so the parts of a version are bounded.

Versions are micro-batch numbers. A replayed batch starts from the version before it and publishes again, with
the same rows. Parts that none of the last ``KEPT`` manifests names are deleted, so that a reader which has
just planned its scan can finish it. A table has one writer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Manifests whose parts stay, and versions between two compactions.
KEPT, COMPACT_EVERY = 4, 16
VERSION = "version"


def newest(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = (VERSION,)) -> DataFrame:
    """For each key the rows with the largest ``order``, column by column; all columns.

    Each step is a hash aggregate of one number or time and a semi-join, so rows are never sorted and
    wide columns never enter an aggregate.
    """
    for column in order:
        best = rows.groupBy(*keys).agg(F.max(column).alias("_best"))
        best = best.select(*[F.col(k).alias(f"_{k}") for k in keys], "_best")
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        rows = rows.join(best, [*same, F.col(column).eqNullSafe(F.col("_best"))], "left_semi")
    return rows


class Snapshots:
    """The table at ``path``; ``partitions`` are columns that parts are partitioned by."""

    def __init__(self, spark: SparkSession, path: str, partitions: Sequence[str] = ()):
        self.spark, self.path, self.partitions = spark, path.rstrip("/"), list(partitions)
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._files = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._files.listStatus(at)) if self._files.exists(at) else []

    def _manifests(self, before: int | None = None) -> list[str]:
        """Names of manifests, oldest first: version, then attempt."""
        names = [n for n in self._names("manifests") if n.endswith(".json")]
        return [n for n in names if before is None or int(n.split("-")[0]) < before]

    def _load(self, manifest: str) -> dict:
        stream = self._files.open(self._path(f"{self.path}/manifests/{manifest}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def parts(self, before: int | None = None) -> list[str]:
        """Parts of the newest version, or of the newest one before ``before``."""
        manifests = self._manifests(before)
        return self._load(manifests[-1])["parts"] if manifests else []

    def read(self, before: int | None = None) -> DataFrame | None:
        """All rows of the newest version (before ``before``) with the versions that wrote them; None if there is none."""
        manifests = self._manifests(before)
        if not manifests:
            return None
        found = self._load(manifests[-1])
        return self._rows(found["parts"], T.StructType.fromJson(found["schema"]))

    def newest(
        self, keys: Sequence[str], before: int | None = None, where: Callable[[DataFrame], DataFrame] = lambda rows: rows
    ) -> DataFrame | None:
        """The newest row of each key of the newest version (before ``before``); ``where`` keeps rows by their keys.

        A single part has one row for each key, so nothing is compared.
        """
        rows = self.read(before)
        if rows is None:
            return None
        rows = where(rows)
        return rows if len(self.parts(before)) == 1 else newest(rows, keys)

    def _rows(self, parts: list[str], schema: T.StructType) -> DataFrame:
        root = f"{self.path}/parts"
        # a part may be empty, so the schema comes from the manifest
        files = self.spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/{p}" for p in parts])
        return files.select(*[F.col(f"`{c}`") for c in schema.names])

    def append(self, rows: DataFrame, version: int) -> None:
        """Publish ``version``: the parts of the version before and one more with ``rows``."""
        rows = rows.withColumn(VERSION, F.lit(version).cast("long"))
        self._publish(version, [*self.parts(version), self._write(rows)], rows.schema)

    def replace(self, rows: DataFrame, version: int) -> None:
        """Publish ``version`` with nothing but ``rows``, which carry their versions."""
        self._publish(version, [self._write(rows)], rows.schema)

    def merge(
        self,
        rows: DataFrame,
        version: int,
        keys: Sequence[str],
        keep: Callable[[DataFrame], DataFrame] = lambda rows: rows,
        compact_every: int = COMPACT_EVERY,
    ) -> None:
        """Publish ``version``, in which ``rows`` take the place of all rows with their keys.

        When it is time to compact, only the newest rows stay, and of them those that ``keep`` returns.
        """
        if len(self.parts(version)) < compact_every:
            return self.append(rows, version)
        rows = rows.withColumn(VERSION, F.lit(version).cast("long"))
        whole = newest(self._rows([*self.parts(version), self._write(rows)], rows.schema), keys)
        self.replace(keep(whole), version)

    def _write(self, rows: DataFrame) -> str:
        part = f"part=p{uuid.uuid4().hex}"
        target = f"{self.path}/parts/{part}"
        # few files of a good size for each partition, whatever the shuffle partitions
        rows.hint("rebalance", *self.partitions).write.partitionBy(*self.partitions).parquet(target)
        return part

    def _publish(self, version: int, parts: list[str], schema: T.StructType) -> None:
        attempt = sum(int(n.split("-")[0]) == version for n in self._manifests())
        target = self._path(f"{self.path}/manifests/{version:020d}-{attempt:06d}.json")
        draft = self._path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        self._files.mkdirs(target.getParent())
        out = self._files.create(draft)
        try:
            out.write(json.dumps({"parts": parts, "schema": schema.jsonValue()}).encode())
        finally:
            out.close()
        if not self._files.rename(draft, target):
            raise OSError(f"could not publish {target}")
        self._vacuum()

    def _vacuum(self) -> None:
        manifests = self._manifests()
        kept = {p for m in manifests[-KEPT:] for p in self._load(m)["parts"]}
        for m in manifests[:-KEPT]:
            self._files.delete(self._path(f"{self.path}/manifests/{m}"), False)
        for p in set(self._names("parts")) - kept:
            self._files.delete(self._path(f"{self.path}/parts/{p}"), True)
