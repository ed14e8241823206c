"""Every registered query against its SQL counterpart, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalog.oracle_queries import ORACLES
from catalog.spark_queries import QUERIES
from check_oracle import rows_of

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) <= set(oracle_sql())
    assert set(QUERIES) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 1


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    frame = queries()[name](spark, SF_DIR)
    result = db.execute(oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, result.fetchall())
