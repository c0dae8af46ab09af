"""Row comparison of a Spark query with its SQL counterpart."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return None if value is None else str(value)


def rows_of(pdf) -> list[tuple]:
    ordered = pdf[sorted(pdf.columns)].astype(object)
    ordered = ordered.where(ordered.notna(), None)
    cells = [tuple(_cell(v) for v in row) for row in ordered.itertuples(index=False)]
    return sorted(cells, key=lambda r: tuple("" if v is None else v for v in r))


def kinds(pdf) -> dict[str, str]:
    return {c: str(pdf[c].dtype) for c in sorted(pdf.columns)}
