"""Runs a query and its SQL over the same tables and compares all values."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(df):
    def text(x):
        if x is None or not isinstance(x, (list, tuple)) and pd.isna(x):
            return "null"
        return f"{x:.6g}" if isinstance(x, float) and x != int(x) else str(int(x)) if isinstance(x, float) else str(x)

    rows = [tuple(text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(df.columns), sorted(rows)


def assert_same(spark, sf, query, sql):
    got, want = plain(query(spark, sf).toPandas()), plain(connect(sf).execute(sql).fetchdf())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
