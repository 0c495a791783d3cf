"""Rows of a query and of its SQL in one comparable form."""

import glob
import os

import duckdb
import pandas as pd


def connect(path):
    con = duckdb.connect()
    for p in glob.glob(f"{path}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def form(df):
    cols = sorted(df.columns)

    def text(v):
        if v is None or pd.isna(v):
            return "null"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return cols, sorted(tuple(map(text, r)) for r in df[cols].astype(object).values)
