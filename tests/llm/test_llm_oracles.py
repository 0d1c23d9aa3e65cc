"""Queries of the operators that SQL can express, against DuckDB on the same tables."""

import os

import pytest

from tallyloom.llm.oracles import ORACLES
from tallyloom.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    import duckdb

    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    oracle = duck.sql(ORACLES[name])
    assert sorted(oracle.columns) == columns
    at = [oracle.columns.index(c) for c in columns]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in oracle.fetchall())
