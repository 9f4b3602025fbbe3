"""Registered drift queries against their SQL on the smallest tables."""

import duckdb
import pytest

from tidemark.plans.oracle import ORACLE
from tidemark.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "customer supplier orders lineitem events".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(table, names):
    return sorted((tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in table), key=repr) if names else []


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    cur = sql.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in names)} FROM ({ORACLE[name]})")
    assert rows(map(tuple, df.select(names).collect()), names) == rows(cur.fetchall(), names)
