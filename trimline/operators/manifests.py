"""Edits of CPU and memory values in manifest texts, as column expressions over their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trimline.functions.quantities import format_cpu, format_memory
from trimline.functions.text import escapes_root

UNREADABLE = "manifest has no content"
NOTHING_CHANGED = "manifest holds no resource value that differs"
NOTHING_CHANGED_IN_VALUES = "values file holds no resource value that differs"
UNSUPPORTED = "resource value of an unsupported form"
OUTSIDE = "path leaves the repository"

# A value may be quoted and may be followed by blanks or a comment, nothing else.
_VALUE = {
    "cpu": r"""(\bcpu:\s*)(["']?)(\d+m?)\2(?=\s*(?:#.*)?$)""",
    "memory": r"""(\bmemory:\s*)(["']?)(\d+[KMGT]i?)\2(?=\s*(?:#.*)?$)""",
}
# A fractional number of cores, which must not be edited by halves.
_FRACTION = r"""\bcpu:\s*["']?\d+\.\d"""
# A line that ends a block: not blank, not indented by two blanks, and no value itself.
_END = r"^(?!  )(?!\s*(?:cpu|memory):)\s*\S"


def _numbers(lines: str, holds) -> Column:
    """Numbers of the lines for which ``holds`` is true."""
    return F.array_compact(F.transform(lines, lambda line, i: F.when(holds(line), i)))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row, however often later lambdas name them."""
    packed = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(packed))


def _with_section(df: DataFrame, section: str, value: str) -> DataFrame:
    """Set the first value of each ``section`` block of ``_lines`` to the column ``value``, unless that is null.

    A block reaches from its heading to the next heading or end line. ``_odd`` tells of a block whose
    first value has a form that is not edited.
    """
    cpu = F.col("resource") == "cpu"

    def of_resource(on_cpu: Column, on_memory: Column) -> Column:
        return F.when(cpu, on_cpu).when(F.col("resource") == "memory", on_memory).otherwise(F.lit(False))

    heading = rf"^\s*{section}:"
    df = _once(
        df,
        _heads=_numbers("_lines", lambda x: x.rlike(heading)),
        _ends=_numbers("_lines", lambda x: x.rlike(heading) | x.rlike(_END)),
        _fit=_numbers("_lines", lambda x: of_resource(x.rlike(_VALUE["cpu"]), x.rlike(_VALUE["memory"]))),
        _unfit=_numbers(
            "_lines", lambda x: of_resource(x.rlike(_FRACTION) & ~x.rlike(_VALUE["cpu"]), F.lit(False))
        ),
    )

    def first_value(head: Column) -> Column:
        """The first value line of a block, null if the block ends before it."""
        after = F.array_min(F.filter(F.concat("_fit", "_unfit"), lambda i: i > head))
        end = F.array_min(F.filter("_ends", lambda i: i > head))
        return F.when(after < F.coalesce(end, F.size("_lines")), after)

    df = _once(df, _set=F.array_compact(F.transform("_heads", first_value)))
    new = F.concat(F.lit("$1"), F.col(value))
    written = F.transform(
        "_lines",
        lambda line, i: F.when(
            F.array_contains("_set", i) & F.array_contains("_fit", i),
            F.when(cpu, F.regexp_replace(line, F.lit(_VALUE["cpu"]), new)).otherwise(
                F.regexp_replace(line, F.lit(_VALUE["memory"]), new)
            ),
        ).otherwise(line),
    )
    edits = F.col(value).isNotNull()
    return _once(
        df,
        _lines=F.when(edits, written).otherwise(F.col("_lines")),
        _odd=F.col("_odd") | (edits & F.arrays_overlap("_set", "_unfit")),
    ).drop("_heads", "_ends", "_fit", "_unfit", "_set")


def edit_manifests(files: DataFrame) -> DataFrame:
    """Write recommended sizes into manifests; no shuffle and no Python.

    ``files``: path, content, field, resource, recommended_request, recommended_limit. The
    request is set in every ``requests`` block, the limit in every ``limits`` block when it is
    positive. Adds ``new_content``, ``changed`` and ``error``; a file without any change is an
    error, and so are a file without content and a path that leaves its repository.
    """
    is_cpu = F.col("resource") == "cpu"

    def shown(name: str):
        return F.when(is_cpu, format_cpu(F.col(name))).otherwise(format_memory(F.col(name)))

    columns = files.columns
    rows = files.withColumns(
        {
            "_request": shown("recommended_request"),
            "_limit": F.when(F.col("recommended_limit") > 0, shown("recommended_limit")),
            "_odd": F.lit(False),
        }
    )
    # a file without content has no lines, and so nothing to edit
    rows = _once(rows, _lines=F.coalesce(F.split("content", "\n"), F.array().cast("array<string>")))
    rows = _with_section(_with_section(rows, "requests", "_request"), "limits", "_limit")
    edited = rows.withColumn("_edited", F.array_join("_lines", "\n"))
    changed = F.col("_edited") != F.col("content")
    in_values = (
        F.col("path").endswith("values.yaml") | F.col("path").endswith("values.yml")
    ) & (F.coalesce(F.col("field"), F.lit("")) != "")
    error = (
        F.when(escapes_root(F.col("path")), F.lit(OUTSIDE))
        .when(F.col("content").isNull(), F.lit(UNREADABLE))
        .when(F.col("_odd"), F.lit(UNSUPPORTED))
        .when(~changed & in_values, F.lit(NOTHING_CHANGED_IN_VALUES))
        .when(~changed, F.lit(NOTHING_CHANGED))
    )
    kept = F.when(F.col("error").isNull(), F.col("_edited")).otherwise(F.col("content"))
    return (
        edited.withColumn("error", error)
        .withColumn("new_content", kept)
        .withColumn("changed", F.col("error").isNull())
        .select(*columns, "error", "new_content", "changed")
    )
