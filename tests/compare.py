"""Spark rows against DuckDB rows, as multisets."""

import os

import duckdb


def connect(sf_dir: str):
    c = duckdb.connect()
    for file in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{file}')")
    return c


def multiset(frame) -> list:
    frame = frame[sorted(frame)]
    return sorted(tuple("NULL" if v is None or v != v else str(v) for v in row) for row in frame.astype(object).itertuples(index=False, name=None))


def assert_same(df, connection, sql: str) -> None:
    ours, theirs = df.toPandas(), connection.execute(sql).df()
    assert sorted(ours) == sorted(theirs)
    assert multiset(ours) == multiset(theirs)
