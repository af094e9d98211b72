"""Every registered query against its SQL twin, whole results, on the small tables."""

import pytest

import __spark_entry__ as entry_points
from compare import compare, connect
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_twin(spark, con, name):
    rows, problems = compare(entry_points.queries()[name](spark, SF), con, entry_points.oracle_sql()[name])
    assert not problems
    assert rows > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
