"""Runs oracle SQL in DuckDB over the tables of a folder, for comparison with a query's rows."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(sql: str, columns: list[str], sf_dir: str) -> list[tuple]:
    db = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return normal(db.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())


def normal(found) -> list[tuple]:
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in found), key=repr)
