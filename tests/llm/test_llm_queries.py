"""The operators' queries against their SQL, and the whole pipeline."""

import math
import os

import duckdb
import pytest

import corpus_pipeline
from gristmill.llm.oracle import ORACLE
from gristmill.llm.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(rows):
    def cell(value):
        if value is None or (isinstance(value, float) and math.isnan(value)):
            return ""
        return repr(float(value)) if isinstance(value, float) else str(value)

    return sorted(tuple(map(cell, row)) for row in rows)


def test_every_operator_has_a_query():
    assert {int(name[2:].split("_")[0]) for name in QUERIES if name != "pipeline"} == set(range(1, 14))
    assert "pipeline" in QUERIES
    assert set(ORACLE) < set(QUERIES)


@pytest.mark.parametrize("name", ORACLE)
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    expected = con.execute(ORACLE[name])
    names = [column[0] for column in expected.description]
    assert sorted(names) == columns
    order = [names.index(column) for column in columns]
    rows = found.select(*columns).collect()
    assert rows
    assert plain(rows) == plain([row[i] for i in order] for row in expected.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "benchmark", "mix", "shards"]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, FOLDER)
        assert after.schema.names == docs.schema.names
        assert after.select("doc_id").distinct().join(kept, "doc_id", "left_anti").count() == 0
        kept = spark.createDataFrame(after.collect(), docs.schema)
    placed = corpus_pipeline.STAGES[-1][1](spark, kept, FOLDER).collect()
    assert sorted(r.doc_id for r in placed) == sorted(r.doc_id for r in kept.collect())
