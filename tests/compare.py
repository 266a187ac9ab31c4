"""Run a query in Spark and its equivalent in DuckDB and compare the results."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _value(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(row[i]) for i in order) for row in rows), key=repr)


def difference(spark_df, connection, sql: str) -> str | None:
    """None if equal, else a short description of the difference."""
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns differ: {sorted(spark_df.columns)} / {sorted(names)}"
    expected = _rows(names, result.fetchall())
    found = _rows(spark_df.columns, spark_df.collect())
    if found == expected:
        return None
    only_spark = [row for row in found if row not in set(expected)][:2]
    only_duck = [row for row in expected if row not in set(found)][:2]
    return f"{len(found)} rows / {len(expected)} rows\n  spark: {only_spark}\n  duckdb: {only_duck}"
