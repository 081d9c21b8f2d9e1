"""Every registered query with SQL gives the rows of that SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")


def plain(value):
    if value is None or (isinstance(value, float) and value != value) or value is pd.NaT or value is pd.NA:
        return "~"
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, float) and abs(value) < 1e15 and value == int(value):
        return str(int(value))
    return str(value)


def rows(frame):
    return sorted("|".join(map(plain, row)) for row in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    session = duckdb.connect()
    for name in TABLES:
        session.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return session


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = registry.queries()[name](spark, FOLDER).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
