"""Every registered query next to its check SQL on the smallest tables."""

import pytest
from oracle_compare import compare, duck

from askance.plans.catalog import CHECKS, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    problem, _, rows = compare(spark, con, sf, QUERIES[name], CHECKS.get(name))
    assert problem is None and rows > 0


def test_every_check_has_its_query():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
