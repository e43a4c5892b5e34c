"""Registered queries of this package: names, and results against their SQL."""

import os

import pytest

import __spark_entry__ as entry
from telewatch.llm import queries

SMALL = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    names = set(queries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)} and len(names) == 13
    assert names | {"pipeline"} <= set(entry.queries()) and set(queries.oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_results_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for table in os.listdir(SMALL):
        db.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{table}'")
    df = entry.queries()[name](spark, SMALL)
    answer = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(df.columns)
    rows = lambda found: sorted(map(str, found))
    assert rows(tuple(r) for r in df.select(*names).collect()) == rows(answer.fetchall())
