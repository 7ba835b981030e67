"""Runs a query's SQL in DuckDB over the same tables."""

from pathlib import Path

import duckdb


def rows(sql, sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = c.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda k: found.columns[k])
    return sorted((tuple(r[k] for k in order) for r in found.fetchall()), key=str)


def spark_rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
