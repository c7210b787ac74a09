"""Every registered core query against its SQL on DuckDB."""

import math
import os

import duckdb
import pytest
from quillmatch.plans.oracle import ORACLES
from quillmatch.plans.queries import QUERIES

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    want = rows_of(columns, found.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        assert a == b
