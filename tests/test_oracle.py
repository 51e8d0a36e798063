"""Every registered query against the SQL in ``oracles.py``."""

import duckdb
import pytest

import __spark_entry__ as contract
from tokenledger.plans.oracles import oracle_sql
from tokenledger.plans.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
ORACLES = oracle_sql()
# Checked against brute force in test_text.py: the outside engine has no look-ahead.
WITHOUT_SQL = {"token_pretoken"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def _sorted(rows, columns):
    places = [columns.index(c) for c in sorted(columns)]
    picked = [tuple(row[i] for i in places) for row in rows]
    return sorted(picked, key=lambda row: [(v is None, "" if v is None else str(v)) for v in row])


def test_every_query_has_sql():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    result = QUERIES[name](spark, sf_dir)
    expected = duck.execute(ORACLES[name])
    columns = [d[0] for d in expected.description]
    assert sorted(result.columns) == sorted(columns)
    ours = _sorted([tuple(r) for r in result.collect()], result.columns)
    theirs = _sorted(expected.fetchall(), columns)
    assert ours, "a check on nothing"
    assert ours == theirs


def test_queries_without_sql_run(spark, sf_dir):
    for name in WITHOUT_SQL:
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 12 and rows[0].total_cost >= rows[-1].total_cost
