"""SQL of the training-data operators: always text, and of those that DuckDB is quick at it gives their rows."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from tesserae.llm.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def rows(frame, columns):
    frame = frame[columns].round(9)
    plain = frame.astype(object).where(frame.notna(), None)
    return Counter(map(repr, plain.values.tolist()))


def test_sql_is_text():
    assert all(isinstance(s, str) for s in SQL.values())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{files}'")
    want = con.execute(SQL[name]).df()
    got = QUERIES[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)
