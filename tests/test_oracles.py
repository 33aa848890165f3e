"""Every query that has an oracle is held against it in DuckDB, at the smallest size."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from proselens.plans import corpus_queries, model_queries, page_queries, stream_queries, text_queries

DATA = "/root/testdata/sf0.001"
PLANS = (text_queries, model_queries, corpus_queries, page_queries, stream_queries)
CASES = [(name, plans) for plans in PLANS for name in plans.QUERIES]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return connection


def plain(rows, columns):
    def value(v):
        if v is None or v != v:
            return "null"
        return repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return sorted(tuple(value(v) for v in row) for row in rows[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name,plans", CASES, ids=[c[0] for c in CASES])
def test_query(spark, duck, name, plans):
    found = plans.QUERIES[name](spark, DATA).toPandas()
    if name in plans.ORACLES:
        wanted = duck.sql(plans.ORACLES[name]).df()
        columns = sorted(wanted.columns)
        assert sorted(found.columns) == columns
        assert plain(found, columns) == plain(wanted, columns)
        assert len(wanted), "a rule that never fires tells nothing"
    else:
        assert len(found.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
