"""Every registered query against its SQL counterpart on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from gristmill.plans.queries import QUERIES as BASE

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "labels", "pages", "conversations", "events")
QUERIES = {name: query for name, query in contract.queries().items() if name in BASE}
ORACLE = {name: sql for name, sql in contract.oracle_sql().items() if name in BASE}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(rows):
    def cell(value):
        if value is None or (isinstance(value, float) and math.isnan(value)):
            return ""
        return repr(float(value)) if isinstance(value, float) else str(value)

    return sorted(tuple(map(cell, row)) for row in rows)


def test_entry(spark):
    found = contract.entry(spark)
    assert found.columns == ["shard", "num_rows", "est_tokens", "text_chars", "text_bytes"]
    assert found.count() > 0


def test_every_query_has_its_counterpart():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    expected = duck.execute(ORACLE[name])
    names = [column[0] for column in expected.description]
    assert sorted(names) == columns
    order = [names.index(column) for column in columns]
    assert plain(found.select(*columns).collect()) == plain(
        [row[i] for i in order] for row in expected.fetchall()
    )
