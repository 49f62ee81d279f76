"""The registered queries of the operators that SQL can express, against their SQL."""

import duckdb
import pytest

from compare import TABLES, compare
from sediment.llm.queries import registered, statements

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(statements()))
def test_query(spark, name):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert name in registered()
    result = compare(spark, connection, name, SF)
    assert result.startswith("ok"), result
