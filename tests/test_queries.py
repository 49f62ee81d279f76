"""Every registered query against its SQL, over the whole small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, compare
from workload.oracle import statements
from workload.queries import registered

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_every_query_has_its_sql():
    assert registered().keys() == statements().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", list(registered()))
def test_query(spark, connection, name):
    result = compare(spark, connection, name, SF)
    assert result.startswith("ok"), result


def test_entry(spark):
    assert entry.entry(spark).count() > 0
