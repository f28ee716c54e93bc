"""Spark results against DuckDB's on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def connect(sf_dir=SMALL):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else tuple(map(plain, value)) if isinstance(value, list | tuple) else value


def rows(frame, columns):
    return sorted((tuple(plain(getattr(v, "item", lambda v=v: v)()) for v in r) for r in frame.select(*columns).collect()), key=repr)


def assert_same(frame, con, sql):
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(frame.columns) == sorted(columns)
    expected = sorted((tuple(plain(float(v) if type(v).__name__ == "Decimal" else v) for v in r) for r in found.fetchall()), key=repr)
    assert rows(frame, columns) == expected
