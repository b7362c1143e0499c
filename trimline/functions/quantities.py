"""Resource quantity parsing and formatting."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Memory suffix -> multiplier.
MEMORY_SUFFIXES = {
    "Ei": 1 << 60,
    "Pi": 1 << 50,
    "Ti": 1 << 40,
    "Gi": 1 << 30,
    "Mi": 1 << 20,
    "Ki": 1 << 10,
    "E": 10**18,
    "P": 10**15,
    "T": 10**12,
    "G": 10**9,
    "M": 10**6,
    "k": 10**3,
}

_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_SUFFIX = "(" + "|".join(MEMORY_SUFFIXES) + ")$"
# a map literal: looked up once per value, where a CASE chain would repeat the suffix match
_FACTORS = "map(" + ", ".join(f"'{k}', {float(v)!r}D" for k, v in MEMORY_SUFFIXES.items()) + ")"
_BLANKS = " \t\n\x0b\f\r\x85\xa0"

GI = 1 << 30
MI = 1 << 20


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def _number(text: Column) -> Column:
    """Double, or NULL unless the whole text is a number.

    The pattern is needed because a plain cast also takes Java suffixes such as ``5d``.
    """
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def _whole(value: Column) -> Column:
    """Truncate to bigint; NULL and out-of-range values become 0."""
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def cpu_millis(quantity: Column) -> Column:
    """``500m`` -> 500, ``2.5`` -> 2500; anything unreadable -> 0."""
    text = _strip(quantity)
    return _whole(
        F.when(text.endswith("m"), _number(F.regexp_replace(text, "m$", ""))).otherwise(
            _number(text) * F.lit(1000.0)
        )
    )


def memory_bytes(quantity: Column) -> Column:
    """``256Mi`` -> 268435456, ``1k`` -> 1000; anything unreadable -> 0."""
    text = _strip(quantity)
    suffix = F.regexp_extract(text, _SUFFIX, 1)
    factor = F.coalesce(F.try_element_at(F.expr(_FACTORS), suffix), F.lit(1.0))
    return _whole(_number(F.regexp_replace(text, _SUFFIX, "")) * factor)


def format_cpu(millis: Column) -> Column:
    """Whole cores as ``2``, everything else as ``1500m``."""
    cores = F.call_function("div", millis, F.lit(1000))
    return F.when(millis % 1000 == 0, cores.cast("string")).otherwise(
        F.concat(millis.cast("string"), F.lit("m"))
    )


def format_memory(size: Column) -> Column:
    """Exact Gi multiples as ``2Gi``, else whole ``Mi`` (rounded down), else plain bytes."""
    return (
        F.when((size >= GI) & (size % GI == 0), F.concat(F.shiftright(size, 30), F.lit("Gi")))
        .when(size >= MI, F.concat(F.shiftright(size, 20), F.lit("Mi")))
        .otherwise(size.cast("string"))
    )


# The same rules as SQL temporary functions, so that SQL users stay on JVM expressions.
_SQL_NUMBER = f"CASE WHEN {{0}} RLIKE r'{_NUMBER}' THEN try_cast({{0}} AS DOUBLE) END"
_SQL_TEXT = r"btrim(q, ' \t\n\u000b\u000c\r\u0085\u00a0')"


def register_sql(spark: SparkSession) -> None:
    """Create ``cpu_millis``, ``memory_bytes``, ``format_cpu`` and ``format_memory`` in SQL."""
    stem = f"regexp_replace({_SQL_TEXT}, r'm$', '')"
    amount = f"regexp_replace({_SQL_TEXT}, r'{_SUFFIX}', '')"
    bodies = {
        "cpu_millis(q STRING) RETURNS BIGINT": f"""
            coalesce(try_cast(CASE WHEN {_SQL_TEXT} LIKE '%m' THEN {_SQL_NUMBER.format(stem)}
                              ELSE {_SQL_NUMBER.format(_SQL_TEXT)} * 1000D END AS BIGINT), 0)""",
        "memory_bytes(q STRING) RETURNS BIGINT": f"""
            coalesce(try_cast({_SQL_NUMBER.format(amount)} *
                              coalesce(try_element_at({_FACTORS}, regexp_extract({_SQL_TEXT}, r'{_SUFFIX}', 1)), 1D)
                              AS BIGINT), 0)""",
        "format_cpu(q BIGINT) RETURNS STRING": """
            CASE WHEN q % 1000 = 0 THEN string(q div 1000) ELSE concat(string(q), 'm') END""",
        "format_memory(q BIGINT) RETURNS STRING": f"""
            CASE WHEN q >= {GI} AND q % {GI} = 0 THEN concat(string(q div {GI}), 'Gi')
                 WHEN q >= {MI} THEN concat(string(q div {MI}), 'Mi') ELSE string(q) END""",
    }
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
