"""Every query with an oracle against DuckDB on the same tables."""

import math
import os

import pytest

from tallyloom.plans import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    try:
        return f"{float(x):.4f}"
    except (TypeError, ValueError):
        return str(x)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, (r[c] for c in columns))) for r in df.collect())
    if name in ORACLES:
        oracle = duck.sql(ORACLES[name])
        assert sorted(oracle.columns) == columns
        at = [oracle.columns.index(c) for c in columns]
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in oracle.fetchall())
