"""Compares a query's rows with those of its DuckDB SQL over the same tables."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value) -> str:
    if value is None:
        return "~"
    if isinstance(value, float):
        return f"{value:.9g}"
    return "[" + ",".join(map(plain, value)) + "]" if isinstance(value, list | tuple) else str(value)


def rows(columns: list[str], found) -> list[tuple[str, ...]]:
    return sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found)


def compare(spark, sf_dir: str, query, sql: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(sql)
    got = query(spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
