"""Comparison of a query with its SQL, and brute-force helpers."""

import glob
import os

import duckdb
import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.6f}"
    if hasattr(v, "__len__") and not isinstance(v, str | bytes):
        return str([_cell(x) for x in v])
    return str(v).replace("T", " ")[:26] if isinstance(v, pd.Timestamp) else str(v)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return list(pdf.columns), sorted(tuple(map(_cell, r)) for r in pdf.itertuples(index=False))


def sql_rows(sql, sf=SF):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return rows(c.execute(sql).df())
