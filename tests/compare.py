"""Spark result against DuckDB result, as multisets of rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p}/*.parquet'" if os.path.isdir(p) else f"create view {t} as select * from '{p}'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(df):
    return sorted(repr(tuple(_value(v) for v in r)) for r in df.select(*sorted(df.columns)).collect())


def sql_rows(con, sql):
    rel = con.sql(sql)
    names = sorted(rel.columns)
    got = rel.project(", ".join(f'"{c}"' for c in names)).fetchall()
    return names, sorted(repr(tuple(_value(v) for v in r)) for r in got)
