"""The operators with SQL give the rows of that SQL on the smallest tables."""

import os

import duckdb
import pytest

from tests.test_queries import FOLDER, TABLES, rows
from tidemark.llm import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    session = duckdb.connect()
    for table in TABLES:
        session.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = registry.queries()[name](spark, FOLDER).toPandas()
    want = session.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
