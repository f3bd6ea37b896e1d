"""Compares a query with its SQL over the driver's tables, order aside."""

import glob
import math
import os

import duckdb

SF = "/root/testdata/sf0.01"


def tables(con, sf=SF):
    for path in glob.glob(f"{sf}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE OR REPLACE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    told = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted(([told(r[i]) for i in order] for r in data), key=repr)


def compare(spark, query, sql, sf=SF):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    tables(con, sf)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    df = query(spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())
