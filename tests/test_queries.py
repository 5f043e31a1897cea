"""Every registered query against its SQL twin, and what its plan must not do."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect
from tagwright.plans.oracles import statements
from tagwright.plans.registered import registered
from tests.conftest import plan_of

QUERIES = registered()


@pytest.fixture(scope="module")
def con(small_folder):
    return connect(small_folder)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(statements()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, small_folder, name):
    assert compare(spark, con, small_folder, name).startswith("ok")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins_or_global_windows(spark, small_folder, name):
    plan = plan_of(QUERIES[name](spark, small_folder))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Window", "PythonUDF"):
        assert node not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
