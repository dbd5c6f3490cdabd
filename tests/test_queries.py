import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, rows_of
from seriesmend.workload import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, small, name):
    frame = QUERIES[name](spark, small)
    got = rows_of(frame.columns, frame.collect())
    cursor = duck.execute(ORACLES[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_query_has_sql_and_is_registered():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= queries().keys()
    assert oracle_sql().keys() <= queries().keys()


def test_entry(spark):
    assert entry(spark).count() > 0
