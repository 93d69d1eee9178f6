"""Comparing a query with its SQL in DuckDB."""

import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(f"{x:.6g}" if isinstance(x, float) else repr(x) for x in r) for r in frame.astype(object).itertuples(index=False))


def compare(spark, query, sql, sf_dir=SMALL, **views):
    """views: further tables as pandas frames, in place of the files."""
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        name = f.split(".")[0]
        if name not in views:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    want = con.execute(sql).fetchdf()
    got = query(spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
