"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from fraglens.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, db, name):
    a, b = catalog.QUERIES[name](spark, SF).toPandas(), db.execute(catalog.SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert [str(a[c].dtype) for c in cols] == [str(b[c].dtype) for c in cols]
    order = lambda d: d[cols].sort_values(cols).reset_index(drop=True).astype(str)
    assert order(a).equals(order(b))


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_cartesian_product(spark):
    plan = catalog.QUERIES["J_04_AGG_08_paired_insertion"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_smoothing_takes_all_features(spark):
    from fraglens.plans import fixtures

    want = fixtures.coords(spark, SF).select("column").distinct().count()
    assert catalog.QUERIES["LA_16_smooth"](spark, SF).select("feature_id").distinct().count() == want > 4
