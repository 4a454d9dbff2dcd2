"""Registered queries against their SQL, and the whole set against what the package promises."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from textquarry.llm import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def test_all_operators_are_registered():
    numbers = {int(name[2:].split("_")[0]) for name in catalog.QUERIES}
    assert numbers == set(range(1, 14))
    assert set(catalog.QUERIES) | {"pipeline"} <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    with duckdb.connect() as duck:
        for path in DATA.glob("*.parquet"):
            duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        want = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})")
        want = sorted(want.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs_on_whole_tables(spark, name):
    source = "pages" if name.startswith("op3_") else "documents"
    rows = catalog.QUERIES[name](spark, str(DATA)).count()
    n = spark.read.parquet(f"{DATA}/{source}.parquet").count()
    assert rows >= n if not name.startswith("op5_") else rows > 0


@pytest.mark.parametrize("name", ["op6_exact_dedup", "op8_chat_format", "op9_secret_scan"])
def test_native_queries_run_no_python(spark, name):
    plan = catalog.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
