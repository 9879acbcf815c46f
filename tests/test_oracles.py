import pytest

from plumbline.plans.registry import ORACLES, QUERIES

from .oracle import same, same_flat

#: Queries with so many rows that they are compared as arrays, and what their rows are sorted by.
WIDE = {"covariance_ellipse": ["event_id", "sigma", "k"]}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    compare = (lambda *x: same_flat(*x, WIDE[name])) if name in WIDE else same
    assert compare(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.01") > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0 and df.schema == QUERIES[name](spark, "/root/testdata/sf0.001").schema
