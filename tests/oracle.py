"""Rows of a query and of its SQL, made comparable."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    return str(v)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in records), key=lambda r: [(x is None, str(x)) for x in r])


def same(spark_df, con, sql):
    rel = con.sql(sql)
    assert sorted(spark_df.columns) == sorted(rel.columns)
    assert rows(spark_df.columns, [tuple(r) for r in spark_df.collect()]) == rows(rel.columns, rel.fetchall())
