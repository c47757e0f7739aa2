"""Hold a query against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or v is pd.NA or v is pd.NaT or v != v else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(str(int(v)) if isinstance(v, float) and v.is_integer() else str(v) for v in map(plain, r)) for r in df.itertuples(index=False)))


def differences(spark_df, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    got, want = spark_df.toPandas(), con.execute(sql).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a == b:
        return ""
    return f"{len(a)} and {len(b)} rows; only here {sorted(set(a) - set(b))[:2]}; only there {sorted(set(b) - set(a))[:2]}"
