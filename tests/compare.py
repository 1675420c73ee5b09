"""Runs registered queries against their SQL in DuckDB: python tests/compare.py SF [NAME...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]) or (len(df) and type(df[c].iloc[0]).__name__ in ("date", "Timestamp", "datetime")):
            df[c] = pd.to_datetime(df[c]).dt.strftime("%Y-%m-%d %H:%M:%S")
        elif pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(str)
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float).round(6) + 0.0
        else:
            df[c] = df[c].map(lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)) else (tuple(x) if isinstance(x, (list, np.ndarray)) else x))
            if df[c].map(lambda x: type(x).__name__ == "Decimal").any():
                df[c] = df[c].astype(float).round(6)
    return df.sort_values(list(df.columns), na_position="first", key=lambda s: s.astype(str)).reset_index(drop=True)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def differences(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    """Empty if equal."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"{len(spark_df)} and {len(sql_df)} rows"
    a, b = canonical(spark_df), canonical(sql_df)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = int(np.flatnonzero(~same.to_numpy())[0])
            return f"{c}: {(~same).sum()} differ, first {a.iloc[i].to_dict()} and {b.iloc[i].to_dict()}"
    return ""


def main() -> int:
    import __spark_entry__ as entry
    from stocktide.session import session

    sf = f"/root/testdata/{sys.argv[1]}"
    spark = session(master="local[6]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="6g")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    sqls, queries = entry.oracle_sql(), entry.queries()
    for name in sys.argv[2:] or [n for n in queries if n in sqls]:
        t = time.time()
        try:
            got = queries[name](spark, sf).toPandas()
            took = time.time() - t
            said = differences(got, con.execute(sqls[name]).df()) if name in sqls else "rows only"
        except Exception as e:  # noqa: BLE001
            got, took, said = [], time.time() - t, f"{type(e).__name__}: {str(e)[:600]}"
        bad += said not in ("", "rows only")
        print(f"{name}: {len(got)} rows, {took:.1f} s {said or 'ok'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
