"""Holds a DataFrame against DuckDB's answer on the same tables."""

import numbers
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple("" if v is None or v is pd.NA or v != v else str(float(v)) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v) for v in r) for r in df[cols].itertuples(index=False))


def compare(df, sql, con):
    got, want = rows(df.toPandas()), rows(con.sql(sql).df())
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not bad, (len(bad), bad[:3])
