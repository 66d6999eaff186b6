"""Comparison of a query with its SQL over the same tables."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    cell = lambda v: None if v is None or v is pd.NaT or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    columns = sorted(df.columns)
    return df[columns].map(cell).sort_values(columns).reset_index(drop=True)


def assert_same(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    a, b = plain(spark_df.toPandas()), plain(con.execute(sql).df())
    pd.testing.assert_frame_equal(a, b)
