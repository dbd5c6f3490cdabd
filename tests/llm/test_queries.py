"""Every registered query of the subpackage: SQL, or a test against plain code."""

import os

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from check import TABLES, rows_of
from seriesmend.llm.queries import ORACLES, QUERIES

# what SQL can't state, and the module that tests it against brute force
TESTED = {
    "op3_sentencepiece": "test_mixing_and_pieces",
    "op4_chat_format": "test_chat",
    "op5_suffix_dedup": "test_substrings",
    "op7_minhash_near_dedup": "test_minhash",
    "op9_recurrent_scores": "test_gru",
    "op10_warc_derivatives": "test_urls_and_warc",
    "op11_html_extraction": "test_extraction",
    "pipeline": "test_pipeline",
}


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, small, name):
    frame = QUERIES[name](spark, small)
    got = rows_of(frame.columns, frame.collect())
    cursor = duck.execute(ORACLES[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted((QUERIES.keys() | {"pipeline"}) - ORACLES.keys()))
def test_query_without_sql_runs_and_is_tested(spark, small, name):
    assert os.path.exists(os.path.join(os.path.dirname(__file__), f"{TESTED[name]}.py"))
    assert queries()[name](spark, small).count() > 0


def test_all_are_registered():
    assert QUERIES.keys() | {"pipeline"} <= queries().keys()
    assert ORACLES.keys() <= oracle_sql().keys()
