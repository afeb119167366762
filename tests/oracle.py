"""Compares a query's rows with those of its SQL, whatever their order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def rows_of(table: pa.Table) -> Counter:
    names = sorted(table.column_names)
    return Counter(zip(*(map(_plain, table.column(c).to_pylist()) for c in names))) if names else Counter()


def differences(ours: pa.Table, theirs: pa.Table) -> str:
    """Empty if both hold the same rows and columns; else what differs."""
    if sorted(ours.column_names) != sorted(theirs.column_names):
        return f"columns {sorted(ours.column_names)} and {sorted(theirs.column_names)}"
    a, b = rows_of(ours), rows_of(theirs)
    if a == b:
        return ""
    return f"{ours.num_rows} and {theirs.num_rows} rows; only ours: {list((a - b).items())[:2]!r:.900}; only theirs: {list((b - a).items())[:2]!r:.900}"
