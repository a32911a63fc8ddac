"""Every registered query against its SQL twin on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as contract  # noqa: E402
from check import TABLES, rows  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return db


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["doc_id", "redacted"]


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, database, name):
    frame = contract.queries()[name](spark, FOLDER)
    got = frame.collect()
    assert got
    sql = contract.oracle_sql().get(name)
    if sql:
        result = database.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(frame.columns)
        assert rows(frame.columns, got) == rows(names, result.fetchall())
