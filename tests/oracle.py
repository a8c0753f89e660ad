"""Side-by-side comparison of a query with its SQL in DuckDB."""

import datetime as dt
import decimal
import glob
import os

import duckdb

TESTDATA = "/root/testdata"


def connect(sf_dir):
    con = duckdb.connect()
    for file in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, function, sql, sf_dir):
    """(spark rows, sql rows, spark columns, sql columns)"""
    df = function(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    result = con.sql(sql)
    theirs = rows_of(result.columns, result.fetchall())
    return mine, theirs, sorted(df.columns), sorted(result.columns)
