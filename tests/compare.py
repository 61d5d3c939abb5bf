"""Rows of a Spark query against rows of its DuckDB counterpart, whatever their order."""

import decimal
import math
import os

import duckdb

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for name in NAMES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return str(v.normalize()) if v else "0"
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else v


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(repr(plain(r[i])) for i in order) for r in rows)


def assert_equal(spark, con, sf_dir, query, sql):
    frame = query(spark, sf_dir)
    result = con.sql(sql)
    got, want = ordered(frame.columns, frame.collect()), ordered(result.columns, result.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
