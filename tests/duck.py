"""Runs a registered query and its SQL on the same files and compares the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, bool) or v is None:
        return repr(v)
    return str(v)


def normal_rows(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> str:
    """Empty text when equal, else what differs."""
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want = normal_rows(want_cols, rel.fetchall())
    got = normal_rows(spark_df.columns, spark_df.collect())
    if sorted(spark_df.columns) != sorted(want_cols):
        only = set(spark_df.columns) ^ set(want_cols)
        return f"columns differ: {sorted(only)}"
    if len(got) != len(want):
        return f"rows: spark {len(got)}, sql {len(want)}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(bad)} of {len(got)} rows differ; cols {sorted(want_cols)}; first {bad[:2]}"
    return ""
