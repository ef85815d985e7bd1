"""Run one registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _kind(series: pd.Series) -> str:
    values = series.dropna()
    if values.empty:
        return "none"
    v = values.iloc[0]
    if isinstance(v, (bool, np.bool_)):
        return "bool"
    if isinstance(v, (int, np.integer)):
        return "int"
    if isinstance(v, (float, np.floating)):
        return "float"
    return type(v).__name__


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith(("datetime", "Int", "Float", "boolean")):
            df[c] = df[c].astype(object)
        df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else v)
    rows = df.astype(str)
    return rows.sort_values(list(rows.columns), kind="stable").reset_index(drop=True)


def differences(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> list[str]:
    out = []
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"]
    if len(spark_df) != len(sql_df):
        out.append(f"rows {len(spark_df)} != {len(sql_df)}")
    for c in spark_df.columns:
        a, b = _kind(spark_df[c]), _kind(sql_df[c])
        if a != b and "none" not in (a, b):
            out.append(f"type of {c}: {a} != {b}")
    left, right = canonical(spark_df), canonical(sql_df)
    if len(left) == len(right):
        bad = (left != right).any(axis=1)
        if bad.any():
            out.append(f"{int(bad.sum())} rows differ, e.g.\n{left[bad].head(3)}\n{right[bad].head(3)}")
    else:
        both = left.merge(right, how="outer", indicator=True)
        out.append(str(both[both["_merge"] != "both"].head(6)))
    return out
