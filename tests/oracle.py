"""Compares a query's rows with those of its SQL in DuckDB, as multisets of values."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def connect(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        value = value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def assert_same(spark, query, sql, sf_dir: str = DATA):
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    con = connect(sf_dir)
    found = con.sql(sql)
    assert got == rows(found.columns, found.fetchall())
