"""Runs a query on Spark and its SQL on DuckDB and compares the rows."""

import os
from collections import Counter

import duckdb


def connect(folder):
    con = duckdb.connect()
    for file in os.listdir(folder):
        if file.endswith(".parquet"):
            con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, list):
        return tuple(map(plain, value))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    relation = con.sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    theirs = rows_of(relation.columns, relation.fetchall())
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
