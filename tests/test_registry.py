"""Every registered query against its SQL, at the smallest scale."""

import pytest
from compare import compare, duck

from cohortry.plans import model_plans, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, SF, registry.QUERIES[name], registry.ORACLE[name]) is None


def test_only_model_fits_lack_sql():
    assert set(registry.QUERIES) - set(registry.ORACLE) == set(model_plans.QUERIES) - set(
        model_plans.ORACLE)


def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
