"""Rows of a query against its SQL on the same files."""

import os

import duckdb
import pandas as pd


def views(folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            path = f"{folder}/{f}"
            c.execute(f"create view {f[:-8]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def _cell(v):
    if v is None or v is pd.NaT or (not hasattr(v, "__len__") and v != v):
        return "NULL"
    if isinstance(v, (int, float)) or type(v).__name__ in ("Decimal", "int64", "int32", "float64", "bool_"):
        return f"{float(v):.6g}"
    return str(v)


def canonical(df):
    df = df[sorted(df.columns)].map(_cell)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(spark_df, sql, folder):
    ours, theirs = canonical(spark_df.toPandas()), canonical(views(folder).execute(sql).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs)
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False)
