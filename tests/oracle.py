"""Holds a query against its SQL in DuckDB, as multisets of rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def rows(pdf, columns):
    return sorted(map(repr, pdf[columns].astype(object).where(pdf[columns].notna(), None).values.tolist()))


def assert_same(df, con, sql: str) -> None:
    got, want = df.toPandas(), con.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
