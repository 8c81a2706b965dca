"""Compares a catalogue query with its SQL in another engine, as bags of rows."""

import glob
import os

import duckdb
import pandas as pd

DATA = os.environ.get("QUERY_TEST_DATA", "/root/testdata/sf0.001")


def rows(frame: pd.DataFrame) -> list:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return None
        if isinstance(v, bool) or hasattr(v, "dtype") and v.dtype == bool:
            return bool(v)
        return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v

    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)), key=repr)


def compare(spark, query, sql: str) -> None:
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = query(spark, DATA).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
