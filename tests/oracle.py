"""Compare a query with its SQL twin the way the driver does."""

from __future__ import annotations

import hashlib
import pathlib

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if pathlib.Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def digest(columns: list[str], rows: list[tuple]) -> tuple[list[str], int, str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted(repr([str(row[i]) for i in order]) for row in rows)
    return sorted(columns), len(rows), hashlib.sha256("\n".join(lines).encode()).hexdigest()


def spark_digest(df: DataFrame) -> tuple[list[str], int, str]:
    return digest(df.columns, [tuple(r) for r in df.collect()])


def duck_digest(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], int, str]:
    result = con.execute(sql)
    return digest([d[0] for d in result.description], result.fetchall())
