"""Compare registered queries with their SQL in DuckDB: ``python -m verification.compare [dir] [names]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

from verification.oracle import ORACLES
from verification.queries import QUERIES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    return None if value is None else (value.item() if hasattr(value, "item") else value)


def _sort_key(row):
    return [(v is None, str(type(v)), str(v)) for v in row]


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted((tuple(r) for r in df.select(*columns).collect()), key=_sort_key)


def oracle_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    relation = con.sql(sql)
    columns = sorted(relation.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    return columns, sorted(relation.select(quoted).fetchall(), key=_sort_key)


def difference(spark, con, name: str, sf_dir: str) -> str | None:
    """None when equal, else a short description."""
    columns, got = spark_rows(QUERIES[name](spark, sf_dir))
    expected_columns, expected = oracle_rows(con, ORACLES[name])
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    if len(got) != len(expected):
        return f"rows {len(got)} != {len(expected)}"
    for a, b in zip(got, expected):
        if a != b:
            return "\n   ".join(["first difference", str(dict(zip(columns, a))), str(dict(zip(columns, b)))])
        if any(type(x) is not type(y) for x, y in zip(a, b)):
            return f"types {[(c, type(x), type(y)) for c, x, y in zip(columns, a, b) if type(x) is not type(y)]}"
    return None


def main() -> None:
    from trimline.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(8), connect(sf_dir)
    for name in names:
        start = time.time()
        if name not in ORACLES:
            print(f"{name:42s} no oracle")
            continue
        try:
            problem = difference(spark, con, name, sf_dir)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{name:42s} {time.time() - start:6.2f}s {'ok' if problem is None else problem}", flush=True)


if __name__ == "__main__":
    main()
