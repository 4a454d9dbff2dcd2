"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from textquarry.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "boolean": "BOOLEAN"}
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    result = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})")
    types = {c[0]: str(c[1]) for c in result.description}
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert got == sorted(result.fetchall())
    spark_types = dict(df.dtypes)
    assert {c: TYPES[spark_types[c]] for c in columns} == types
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["doc_id", "prompt"]
    assert 0 < df.count() <= 100
