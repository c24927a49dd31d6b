"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import pytest

from leasegrid.plans.catalog import REGISTRY

from .oracle import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = [n for n, q in REGISTRY.items() if q.sql is not None]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    ok, msg = compare(REGISTRY[name].run(spark, SF), con, REGISTRY[name].sql)
    assert ok, msg
