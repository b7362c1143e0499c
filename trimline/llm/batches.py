"""Bounded pieces of work inside a task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame

#: Characters of text that one round of array work takes; a longer text is a piece of its own.
CHARS = 1 << 18
#: Bytes of one Arrow batch, where the session names no bound.
BATCH_BYTES = "4m"


def bound_batches(df: DataFrame) -> DataFrame:
    """Give Arrow batches a bound in bytes, so that long texts do not pile up in a Python worker."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, BATCH_BYTES)
    return df


def pieces(texts: Sequence[str | None], limit: int = CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) of consecutive texts with ``limit`` characters together; null is empty."""
    first, size, held = 0, 0, []
    for i, text in enumerate(texts):
        text = text or ""
        if held and size + len(text) > limit:
            yield first, held
            first, size, held = i, 0, []
        held.append(text)
        size += len(text)
    if held:
        yield first, held
