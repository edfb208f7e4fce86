"""Queries held against the SQL that DuckDB runs on the same tables."""

from pathlib import Path

import duckdb


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


def compare(spark, folder, query, sql):
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from read_parquet('{f}')")
    df = query(spark, folder)
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(want.fetchall(), want.columns)
