"""Spark's rows against DuckDB's, as multisets of rows with columns in name order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_rows(sf: str, sql: str):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = con.sql(sql)
    return got.columns, [str(x) for x in got.types], got.fetchall()


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v) + 0.0:.6f}"
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def differences(df, sf: str, sql: str) -> list:
    columns, _, want = oracle_rows(sf, sql)
    assert sorted(columns) == sorted(df.columns), (columns, df.columns)
    order = sorted(columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in want)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    if got == want:
        return []
    return [len(got), len(want), [x for x in zip(got, want) if x[0] != x[1]][:3]]
