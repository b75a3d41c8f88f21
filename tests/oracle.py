"""Compares a query with its SQL on DuckDB, as sets of rounded rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def rounded(v):
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "is_integer") or type(v).__name__ == "Decimal":
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(rounded(x) for x in v)
    return v


def assert_same(spark, query, sql, sf_dir=SMALL):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, want = query(spark, sf_dir), con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    at = {c: i for i, c in enumerate(want.columns)}
    rows = sorted((tuple(rounded(r[c]) for c in sorted(at)) for r in df.collect()), key=repr)
    assert rows == sorted((tuple(rounded(r[at[c]]) for c in sorted(at)) for r in want.fetchall()), key=repr)
