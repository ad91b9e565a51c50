"""Every query with an oracle equals it, on the smallest tables."""

import duckdb
import pytest
from __spark_entry__ import entry
from workload.oracle import oracle as oracle_sql
from workload.queries import all_queries as queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')"
        )
    return connection


def order(row):
    return tuple((value is None, str(value)) for value in row)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_oracle(spark, sf_dir, duck, name):
    found = queries()[name](spark, sf_dir)
    columns = sorted(found.columns)
    ours = [tuple(row[c] for c in columns) for row in found.collect()]
    cursor = duck.execute(oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    theirs = [tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()]
    assert sorted(ours, key=order) == sorted(theirs, key=order)
    assert ours


def test_every_oracle_has_a_query():
    assert set(queries()) == set(oracle_sql())


def test_entry(spark):
    found = entry(spark)
    assert found.columns == ["token_id", "token", "kind", "cnt"]
    assert found.count() > 103
