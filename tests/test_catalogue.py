"""Every query with an oracle against DuckDB, and every other one for its rows."""

import duckdb
import pytest

from conftest import DATA
from lodestone.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    if name not in ORACLE_SQL:
        assert got
        return
    want = duck.sql(ORACLE_SQL[name])
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=str)
