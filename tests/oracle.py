"""Runs a query in Spark and its SQL in DuckDB on the same tables and compares the rows."""

import decimal
import math
import os
from collections import Counter

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str = SF):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return str(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def compare(spark, build, sql: str, sf_dir: str = SF) -> None:
    df = build(spark, sf_dir)
    columns = sorted(df.columns)
    mine = Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    rel = database(sf_dir).sql(sql)
    names = rel.columns
    assert sorted(names) == columns
    theirs = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall())
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
